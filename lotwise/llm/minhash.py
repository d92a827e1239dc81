"""Near-duplicate components by a signature-coordinate inverted join over MinHash signatures.

1. Every row gets a number, and its text becomes its set of shingle hashes and a signature of COORDS
   MinHash coordinates, with one further bit of each coordinate packed into a 64-bit sketch. Texts with
   equal sets form one class; the class's least row number stands for it from here on.
2. Each representative is posted under every (coordinate, value) key, and the keys are counted.
   Two sets with Jaccard similarity at the threshold agree in at least MATCHES coordinates (but for
   a chance of about 3e-7), so ordering keys by rarity, they share one of the first
   COORDS - MATCHES + 1. Only this prefix stays posted: frequent keys are skipped, and a
   representative whose rare keys are all its own drops out.
3. Each key links its members to its least member, its hub. Pairs whose sketches differ in more than
   APART bits go (at the threshold a pair does so with a chance of about 2e-8). For the others
   collisions are counted over the whole signatures, and at MATCHES or more the link is confirmed on
   the full sets.
4. Two documents sharing a key share its hub. Where a hub's members still lie in several components,
   pairs across components are compared by sketch and confirmed like those of step 3. Groups above
   SMALL_GROUP members are compared in blocks instead: the members outside the largest component
   with all others, by sketch first, which only names the documents that have a partner; then an
   inverted index over the sets of these counts common shingles, and links need their MATCHES collisions
   as they do in small groups. Nothing is emitted but confirmed links, at most one for each document
   and component. Blocks hold a bounded number of shingles, whatever the size of the group, and blocks
   of incompatible set sizes never meet.
5. Components of all confirmed links, carried back to every row of each class.

A key whose members lie in G components within reach of each other's sketches costs G^2 sketch
comparisons in blocks: the work that an inverted join has with frequent coordinates.

Sets hold 64-bit hashes of the shingles; shingles are of ``size`` words. Results for odd rows: null,
empty and all-space texts have an empty set and stand alone; a text of fewer words is one shingle; rows
that repeat a doc_id are documents each, linked by their own texts; component_id is the least doc_id that
is not null among the rows reached, null if there is none; an empty table gives an empty result;
columns other than the two named are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, KEY, broadcast_if_small, discard, keyed, mix64, small_batches, stored, text_words, without
from .components import connected

COORDS, MATCHES = 64, 34
PREFIX = COORDS - MATCHES + 1
#: Links: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 80
#: Words of a shingle.
SHINGLE = 2
#: Sketches of similar sets differ in at most so many of their 64 bits.
APART = 22
#: Groups of step 4 above so many members are compared in blocks.
SMALL_GROUP = 48
#: A block of step 4 holds about this many documents and shingles at most.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 250_000

_rng = np.random.default_rng(64)
_MULTIPLY = (_rng.integers(0, 1 << 32, COORDS, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, COORDS, dtype=np.uint32)[:, None]
_COORD = np.arange(COORDS, dtype=np.uint64)

SIGNATURES = "doc_id long, key1 long, key2 long, n long, set_key binary, bits long, sig array<long>"
SETS = "row long, n long, sig array<long>, shingles array<long>"


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; of all words if there are fewer."""
    many = min(size, len(words))
    if many > 1:
        last, out = len(words) - many + 1, words[: len(words) - many + 1]
        for k in range(1, many):
            x = words[k : k + last]
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + (x ^ (x >> np.uint64(29))))
        words = out
    return np.unique(words)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Per coordinate the shingle whose permuted hash is least, tagged with the coordinate."""
    if not len(shingles):
        return np.empty(0, np.int64)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    best, at = None, None
    for k in range(0, len(high), 2048):
        x = high[None, k : k + 2048] * _MULTIPLY + _ADD
        i = x.argmin(axis=1)
        v = np.take_along_axis(x, i[:, None], 1)[:, 0]
        if best is None:
            best, at = v, i
        else:
            at = np.where(v < best, i + k, at)
            best = np.minimum(best, v)
    return ((mix64(shingles[at]) & ~np.uint64(COORDS - 1)) | _COORD).view(np.int64)


def sketch(sig: np.ndarray) -> int:
    """One bit of every coordinate's value, packed."""
    return int(np.bitwise_or.reduce(((sig >> 20) & 1) << _COORD.astype(np.int64))) if len(sig) else 0


def _lists(values: list[np.ndarray]):
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64, copy=False)))


def _signed(size: int):
    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            n, keys, sigs = [], [], []
            for _, words in text_words(batch.column("text")):
                s = shingle_set(words, size)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s))
            kept = [batch.column(c) for c in ("doc_id", *KEY)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array([sketch(s) for s in sigs], pa.int64()), _lists(sigs)], ["doc_id", *KEY, "n", "set_key", "bits", "sig"])

    return run


def _shingled(size: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(words, size) for _, words in text_words(batch.column("text"))]
            sigs = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), _lists(sigs), _lists([s.view(np.int64) for s in sets])], ["row", "n", "sig", "shingles"])

    return run


class Corpus:
    """Documents with their signed rows: (row, doc_id, key1, key2, n, set_key, bits, sig)."""

    def __init__(self, docs: DataFrame, size: int):
        small_batches(docs.sparkSession)
        self.size = size
        self.docs = keyed(docs)
        signed = self.docs.select("doc_id", *KEY, "text").mapInArrow(_signed(size), SIGNATURES)
        self.signed = stored(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
        #: Keys that several rows have, with the same doc_id and text.
        self.repeated = stored(self.signed.groupBy(KEY).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1).select(KEY), "repeated")
        self.repeats = bool(self.repeated.limit(1).count())

    def sets_of(self, rows: DataFrame) -> DataFrame:
        """Signatures and full sets of the numbered ``rows``."""
        ids = broadcast_if_small(stored(self.signed.select("row", *KEY).join(rows.select("row").distinct(), "row"), "ids"), BROADCAST_IDS)
        found = self.docs.select(*KEY, "text").join(ids, KEY).select("row", *KEY, "text")
        if self.repeats:  # one text for each number
            once = found.join(self.repeated, KEY, "left_anti").select("row", "text")
            found = once.unionByName(found.join(self.repeated, KEY, "left_semi").groupBy("row").agg(F.first("text").alias("text")))
        return stored(found.select("row", "text").mapInArrow(_shingled(self.size), SETS), "sets")


def close(n1, n2, bits1, bits2):
    """Whether set sizes and sketches allow the similarity."""
    sizes = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * SIMILARITY
    return sizes & (F.bit_count(F.col(bits1).bitwiseXOR(F.col(bits2))) <= APART)


def postings(signed: DataFrame) -> DataFrame:
    """(hub, doc, n, bits, near): who meets which hub under a key of both prefixes, once each, and
    whether the two can be similar."""
    first = [F.first(c).alias(c) for c in ("n", "bits", "sig")]
    classes = signed.where(F.col("n") > 0).groupBy("set_key").agg(F.min("row").alias("doc"), *first)
    posted = stored(classes.select("doc", "n", "bits", F.explode("sig").alias("key")), "posted")
    counts = stored(posted.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1), "counts")
    shared = posted.join(counts, "key").groupBy("doc").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.sort_array(F.collect_list(F.struct("members", "key"))).alias("keys"))
    slots = F.lit(PREFIX - COORDS) + F.size("keys")
    prefix = shared.where(slots > 0).select("doc", "n", "bits", F.explode(F.slice("keys", F.lit(1), slots)).alias("k")).select(F.col("k.key").alias("key"), "doc", "n", "bits")
    prefix = stored(prefix, "prefix")
    discard(posted, counts)
    hubs = prefix.groupBy("key").agg(F.min(F.struct("doc", "n", "bits")).alias("h"), F.count(F.lit(1)).alias("m"))
    hubs = stored(hubs.where(F.col("m") > 1).select("key", F.col("h.doc").alias("hub"), F.col("h.n").alias("n_hub"), F.col("h.bits").alias("bits_hub")), "hubs")
    met = prefix.join(hubs, "key").select("hub", "doc", "n", "bits", close("n", "n_hub", "bits", "bits_hub").alias("near")).distinct()
    out = stored(met, "members")
    discard(prefix, hubs)
    return out


def confirmed(corpus: Corpus, pairs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose signatures collide often enough and whose full sets are similar."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    sets = corpus.sets_of(pairs.select(F.explode(F.array("a", "b")).alias("row")))
    side = lambda x: sets.select(F.col("row").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "sig", "shingles")))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    collisions = F.size(F.array_intersect("sig_a", "sig_b"))
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    links = stored(both.where(collisions >= MATCHES).where(common * (100 + SIMILARITY) >= (F.col("n_a") + F.col("n_b")) * SIMILARITY).select("a", "b"), "links")
    discard(sets, pairs)
    return links


def split_groups(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of hub groups that lie in several components: of small groups, and of large ones
    with a column minor, whether outside the group's largest component."""
    parts = members.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("c"))
    groups = parts.groupBy("hub").agg(F.count(F.lit(1)).alias("parts"), F.sum("c").alias("docs"), F.max(F.struct("c", "component")).alias("most"))
    groups = stored(groups.where(F.col("parts") > 1).select("hub", "docs", F.col("most.component").alias("major")), "groups")
    rows = members.join(groups, "hub")
    small = rows.where(F.col("docs") <= SMALL_GROUP).drop("docs", "major")
    large = rows.where(F.col("docs") > SMALL_GROUP).select("hub", "doc", "component", "n", "bits", (F.col("component") != F.col("major")).cast("int").alias("minor"))
    return small, stored(large, "large")


def small_pairs(small: DataFrame) -> DataFrame:
    """Pairs (a, b) across components of a small group that can be similar."""
    x = small.select("hub", *(F.col(c).alias(f"{c}_a") for c in ("doc", "component", "n", "bits")))
    y = small.select("hub", *(F.col(c).alias(f"{c}_b") for c in ("doc", "component", "n", "bits")))
    across = (F.col("doc_a") < F.col("doc_b")) & (F.col("component_a") != F.col("component_b")) & close("n_a", "n_b", "bits_a", "bits_b")
    return x.join(y, "hub").where(across).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))


def blocks(large: DataFrame) -> DataFrame:
    """(unit, doc, component, n, bits, side): large groups cut into units of bounded size so that every
    pair that is not inside the largest component meets in a unit. Groups are cut by set size (bands
    of ratio 1.25, only equal and neighbouring bands can link), by being minor, and by hash."""
    large = large.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.2500001)))).cast("int"))
    cells = large.groupBy("hub", "band", "minor").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    cells = cells.select("hub", "band", "minor", F.greatest(F.ceil(F.col("c") / BLOCK_DOCS), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int").alias("cuts"))
    cells = stored(cells, "cells")
    own = stored(large.join(cells, ["hub", "band", "minor"]).withColumn("cut", F.pmod(F.xxhash64("doc"), F.col("cuts")).cast("int")).select("hub", "doc", "component", "n", "bits", "band", "minor", "cut"), "own")
    # the cells that a cell meets: same or next band, one of both outside the largest component
    meets = stored(
        cells.select("hub", "band", "minor", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band2"))
        .join(cells.select("hub", F.col("band").alias("band2"), F.col("minor").alias("minor2"), F.col("cuts").alias("cuts2")), ["hub", "band2"])
        .where(F.col("minor") + F.col("minor2") > 0),
        "meets",
    )
    met = own.join(meets, ["hub", "band", "minor"]).withColumn("cut2", F.explode(F.sequence(F.lit(0), F.col("cuts2") - 1)))
    here, there = F.struct("band", "cut", "minor"), F.struct(F.col("band2").alias("band"), F.col("cut2").alias("cut"), F.col("minor2").alias("minor"))
    first, second = F.least(here, there), F.greatest(here, there)
    unit = F.struct("hub", *(x[c].alias(f"{short}{k}") for k, x in ((1, first), (2, second)) for c, short in (("band", "b"), ("cut", "s"), ("minor", "m"))))
    big = met.select(unit.alias("unit"), "doc", "component", "n", "bits", F.when(here == there, 0).when(here < there, 1).otherwise(2).alias("side"))
    name = F.concat_ws(":", *(F.col(f"unit.{c}").cast("string") for c in ("hub", "b1", "s1", "m1", "b2", "s2", "m2")))
    return stored(big.withColumn("unit", name), "blocks")


def _asking(comp: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, bool]:
    """Rows of a unit to compare with the others: those of side 1 with side 2, or where the unit
    meets itself, those outside its largest component with all."""
    if (side > 0).any():
        return np.flatnonzero(side == 1), True
    parts, sizes = np.unique(comp, return_counts=True)
    return np.flatnonzero(comp != parts[sizes.argmax()]), False


def _partnered(group):
    """The documents of a unit that have a possible partner in another component, by sketch."""
    n, comp, side, bits = (group[c].to_numpy() for c in ("n", "component", "side", "bits"))
    asking, two_sided = _asking(comp, side)
    with_partner = np.zeros(len(n), dtype=bool)
    for i in asking:
        ok = (np.bitwise_count((bits ^ bits[i]).view(np.uint64)) <= APART) & (comp != comp[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * SIMILARITY)
        if two_sided:
            ok &= side == 2
        if ok.any():
            with_partner |= ok
            with_partner[i] = True
    return group.loc[with_partner, ["unit", "doc", "component", "n", "side"]]


def _linked(group):
    """Confirmed links between different components inside one unit, at most one for each document
    and component."""
    import pandas as pd

    n, comp, side, doc = (group[c].to_numpy() for c in ("n", "component", "side", "doc"))
    flat, sigs = np.concatenate(group["shingles"].to_list()), np.stack(group["sig"].to_list())
    owner = np.repeat(np.arange(len(n)), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found_a, found_b = [], []
    asking, two_sided = _asking(comp, side)
    for i in asking:
        s = group["shingles"].iat[i]
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        width = hi - lo
        hits = np.repeat(hi - np.cumsum(width), width) + np.arange(width.sum())
        common = np.bincount(owner[hits], minlength=len(n))
        ok = (common * (100 + SIMILARITY) >= (n + n[i]) * SIMILARITY) & (comp != comp[i])
        if two_sided:
            ok &= side == 2
        ok[ok] = (sigs[ok] == sigs[i]).sum(axis=1) >= MATCHES
        for j in np.flatnonzero(ok)[np.unique(comp[ok], return_index=True)[1]]:
            found_a.append(doc[i])
            found_b.append(doc[j])
    return pd.DataFrame({"a": np.array(found_a, dtype=np.int64), "b": np.array(found_b, dtype=np.int64)})


def large_links(corpus: Corpus, large: DataFrame) -> DataFrame:
    """Confirmed links (a, b) inside large groups."""
    units = blocks(large)
    partnered = stored(units.groupBy("unit").applyInPandas(_partnered, "unit string, doc long, component long, n long, side int"), "partnered")
    sets = corpus.sets_of(partnered.select(F.col("doc").alias("row")))
    cut = partnered.join(sets.select(F.col("row").alias("doc"), "sig", "shingles"), "doc")
    return stored(cut.groupBy("unit").applyInPandas(_linked, "a long, b long"), "large_links")


def near_links(corpus: Corpus) -> DataFrame:
    """(node, component) of the class representatives that link with any other."""
    members = postings(corpus.signed)
    first = confirmed(corpus, members.where("near and doc != hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")))
    roots = stored(connected(first), "roots")
    placed = members.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("hub", "doc", "n", "bits", F.coalesce("component", "doc").alias("component"))
    placed = stored(placed, "placed")
    small, large = split_groups(placed)
    links = first.unionByName(confirmed(corpus, small_pairs(small))).unionByName(large_links(corpus, large))
    return stored(connected(links), "components")


def placed_rows(corpus: Corpus, least: Column) -> DataFrame:
    """(doc_id, key1, key2, n, best): every row with the minimum of ``least`` over its component; null for
    rows with an empty set."""
    components = near_links(corpus)
    classes = corpus.signed.where(F.col("n") > 0).groupBy("set_key").agg(F.min("row").alias("node"), F.min(least).alias("best"))
    classes = stored(classes.join(components, "node", "left").select("set_key", F.coalesce("component", "node").alias("root"), "best"), "classes")
    roots = stored(classes.groupBy("root").agg(F.min("best").alias("best")), "root_classes")  # two plain scans meet: AQE can split a large component
    classes = stored(classes.drop("best").join(roots, "root").select("set_key", "best"), "placed_classes")
    return corpus.signed.select("doc_id", *KEY, "n", "set_key").join(classes, "set_key", "left").drop("set_key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = placed_rows(Corpus(docs, size), F.col("doc_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("best")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of every component, that of the least doc_id, and all rows with an empty set; all columns."""
    corpus = Corpus(docs, size)
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *KEY)
    rows = stored(placed_rows(corpus, least).where(F.col("best").isNotNull()), "near_rows")
    winning = (F.col("key1") == F.col("best.key1")) & (F.col("key2") == F.col("best.key2"))
    again = rows.where(winning).join(corpus.repeated, KEY, "left_semi") if corpus.repeats else None
    return without(docs, rows.where(~winning), again)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.d, r.root FROM r JOIN (SELECT a AS s, b AS d FROM e UNION ALL SELECT b, a FROM e) t ON t.s = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""
