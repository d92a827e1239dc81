"""Portfolio and price-series analytics as Spark jobs over many portfolios, symbols and strategies."""
