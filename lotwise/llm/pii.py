"""Personal data: base patterns with exact spans, and bootstrapped contextual extraction.

Base. Emails, IP addresses, card numbers and phone numbers are found by pattern, leftmost and without
overlap inside each kind; matches that fail their check (parts, digits, Luhn) are dropped. Offsets are
code points: the texts between matches and the matches are measured in order.

Bootstrapping. Every base span is an instance and a seed of its kind, whatever its form. Words outside
base spans that could be identifiers are the other instances: those with a digit, a sign between
letters, or two capitals. Of these, long runs of letters and digits mixed are seeds too, of the kind
secret. The lexical patterns of an instance are the word before it, the two words before it, and the
word behind it. Over the whole graph of patterns and instances Spark repeats until no score
changes by more than SETTLED: for each kind a pattern scores the mean of its instances; an instance that
is a seed counts 1 for its own kind and 0 for others, any other counts DAMPING times the greatest score
that a pattern of it has for the kind. So scores pass through patterns without seeds too, grow from round
to round and settle, and no circle of patterns feeds itself. A pattern stands for the kind of its greatest
score. Patterns with a score of at least ACCEPT, over enough seeds and distinct instances, are looked up in all texts: their score is multiplied by the share of their occurrences
that have a candidate there and not a plain word. Those that still reach ACCEPT extract all their
instances outside base spans as spans of kind ``id``, and the candidate words with a digit that follow
these without any other word between; spans one blank apart are one. Base spans are never changed. Plain
words are not candidates.

DataFrame functions only. Texts are read twice, whole; only spans and hashes of contexts are stored.

Results for odd rows: a null text is empty and has no spans; rows that repeat a doc_id are scanned
each by itself; an empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, discard, stored

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the base patterns: the same matches, without backtracking over long runs. A
#: match begins where the run of its first class does, or where the match before it ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IP_PART = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_CHECK = rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"
#: A word with a digit, a sign between letters, or two capitals: in a text, and by itself.
CANDIDATE = r"(?:[^\s0-9]*+[0-9]|\S*?\p{L}[-_.@/:]++\p{L}|\S*?\p{Lu}\S*?\p{Lu})"
INSTANCE, IS_INSTANCE = rf"(?<!\S){CANDIDATE}\S*+", f"^{CANDIDATE}"
#: A run of letters and digits mixed, as keys and tokens are.
SECRET = r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+=-]{20,}$"
#: Kinds of seeds: those of the base patterns, secret, and none.
SECRET_KIND, NO_KIND = len(KINDS), -1
#: How much of a pattern's score an instance passes on; the change that counts as none; rounds at most,
#: which is more than scores can take to settle (DAMPING ** ROUNDS < SETTLED).
DAMPING, SETTLED, ROUNDS = 0.8, 1e-3, 40
#: What an accepted pattern has at least.
ACCEPT, MIN_SEEDS, MIN_INSTANCES = 0.8, 3, 5
#: Up to this many patterns are broadcast.
BROADCAST_PATTERNS = 1_000_000
#: Items of an array that is built up, and characters in which spans and words meet.
BLOCK, CELL = 256, 256

MARKS = "array<struct<start:bigint,kind:int,end:bigint,instance:bigint>>"
SEEN = "array<struct<start:bigint,end:bigint,from:bigint,to:bigint,instance:bigint,secret:boolean,digit:boolean,place:int,before:array<bigint>,behind:bigint>>"
SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, step) -> Column:
    """The numbers that ``step(so far, item)`` gives at each item, from 0 on; taken in blocks, so that the
    arrays that are built up stay short."""
    cut = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda b: F.slice(z, b * BLOCK + 1, BLOCK))
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    one = lambda acc, x: let(step(acc["at"], x), lambda at: state(at, F.concat(acc["out"], F.array(at))))

    def block(acc: Column, part: Column) -> Column:
        inside = F.aggregate(part, state(acc["at"], F.array().cast("array<bigint>")), one)
        return let(inside, lambda done: state(done["at"], F.concat(acc["out"], F.array(done["out"]))))

    return F.flatten(F.aggregate(cut(items), state(F.lit(0).cast("long"), F.array().cast("array<array<bigint>>")), block)["out"])


def placed(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of the matches, null without any. Ends are running sums over gaps and
    matches."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(gaps, found, lambda g, m: F.struct((F.length(g) + F.length(m)).cast("long").alias("step"), F.length(m).cast("long").alias("width"), m.alias("text")))
    parts = F.filter(parts, lambda p: p["text"].isNotNull())
    span = lambda p, end: F.struct((end - p["width"]).alias("start"), end.alias("end"), p["text"].alias("text"))
    ends = lambda z: running(z, lambda at, p: at + p["step"])
    return F.when(F.regexp_like(text, F.lit(pattern)), let(parts, lambda z: F.zip_with(z, ends(z), span)))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        digit = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, digit).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), value), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(match, F.lit(IP_CHECK))
    if kind == "card":
        return let(digits(match), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def after_words(*words: Column) -> Column:
    """The pattern of what follows these words, null if one is."""
    return F.when(words[0].isNotNull(), F.xxhash64(F.lit(len(words)), *map(F.lower, words)))


def before_word(word: Column) -> Column:
    return F.when(word.isNotNull(), F.xxhash64(F.lit(-1), F.lower(word)))


def base_marks(text: Column) -> Column:
    """All base spans, ordered by start, then kind, as seeds: array of (start, kind, end, instance)."""

    def of(k: int, kind: str) -> Column:
        kept = F.filter(placed(text, PATTERNS[kind]), lambda m: holds(kind, m["text"]))
        mark = lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), F.xxhash64(F.lower(m["text"])).alias("instance"))
        return F.coalesce(F.transform(kept, mark), F.array().cast(MARKS))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def candidates(text: Column) -> Column:
    """Candidate words: where the word stands (start, end) and where it does without other signs at its
    ends (from, to), its place among all words, its patterns, and whether it looks like a secret."""

    def one(m: Column, place: Column, words: Column) -> Column:
        lead = F.length(m["text"]) - F.length(F.regexp_replace(m["text"], r"^[^\p{L}0-9+]+", ""))
        core = F.regexp_replace(m["text"], r"^[^\p{L}0-9+]+|(?<![^\p{L}0-9])[^\p{L}0-9]++$", "")
        at = lambda k: F.get(words, place + k)
        return F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            (m["start"] + lead).alias("from"),
            (m["start"] + lead + F.length(core)).alias("to"),
            F.xxhash64(F.lower(core)).alias("instance"),
            F.regexp_like(core, F.lit(SECRET)).alias("secret"),
            F.regexp_like(core, F.lit("[0-9]")).alias("digit"),
            place.alias("place"),
            F.array_compact(F.array(after_words(at(-1)), after_words(at(-2), at(-1)))).alias("before"),
            before_word(at(1)).alias("behind"),
        )

    def all_of(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, k: F.when(F.regexp_like(w, F.lit(IS_INSTANCE)), k)), lambda k: k.isNotNull())
        return F.zip_with(placed(text, INSTANCE), places, lambda m, k: one(m, k, words))

    return F.when(F.regexp_like(text, F.lit(INSTANCE)), let(words_of(text), all_of)).cast(SEEN)


def with_covered(marks: Column, seen: Column) -> Column:
    """The candidate words with ``covered``, whether a base span covers any of a word. In the order of
    span starts and word ends, a word is covered if the greatest end of the spans so far is behind its start."""
    spans = F.transform(marks, lambda m: F.struct((m["start"] * 2).alias("key"), m["end"].alias("stop")))
    ends = F.transform(seen, lambda w: F.struct((w["end"] * 2 - 1).alias("key"), F.lit(None).cast("long").alias("stop")))

    def tops(items: Column) -> Column:
        reach = running(items, lambda at, x: F.greatest(at, F.coalesce(x["stop"], F.lit(0).cast("long"))))
        both = F.zip_with(items, reach, lambda x, top: F.struct(x["stop"].isNull().alias("word"), top.alias("top")))
        return F.transform(F.filter(both, lambda x: x["word"]), lambda x: x["top"])

    marked = F.zip_with(seen, let(F.array_sort(F.concat(spans, ends)), tops), lambda w, top: w.withField("covered", top > w["start"]))
    return F.when(F.size(marks) == 0, F.transform(seen, lambda w: w.withField("covered", F.lit(False)))).otherwise(marked)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, marks, seen): a row number, the base spans and the candidate words of every
    document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), base_marks(text).alias("marks"), candidates(text).alias("seen"))
    rows = rows.select("doc_id", "marks", F.when(F.size("seen") > 0, with_covered(F.col("marks"), F.col("seen"))).alias("seen"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "scan")


def cells(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / CELL), F.floor((end - 1) / CELL)))


def met(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(row, kind, at, instance, place, before, behind): base spans with the covered ``words`` that they
    cover, wholly or in part. Both meet in cells of the text."""
    spans = rows.select("row", F.explode("marks").alias("m")).select("row", F.col("m.kind").alias("kind"), F.col("m.start").alias("at"), F.col("m.end").alias("stop"), F.col("m.instance").alias("found"))
    spans = spans.select("*", cells(F.col("at"), F.col("stop")).alias("cell"))
    words = words.select("row", "place", "start", "end", "before", "behind", cells(F.col("start"), F.col("end")).alias("cell"))
    both = spans.join(words, ["row", "cell"]).where((F.col("at") < F.col("end")) & (F.col("stop") > F.col("start")))
    return both.select("row", "kind", "at", F.col("found").alias("instance"), "place", "before", "behind").distinct()


def score_graph(edges: DataFrame) -> DataFrame:
    """(pattern, stands, score, seeds, instances) over (pattern, instance, kind) edges, once scores have
    settled. Patterns of less than MIN_INSTANCES instances can't be accepted and are left out. Rows are
    kept for scores above 0 only: the work is that of what seeds reach."""
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances")).where(F.col("instances") >= MIN_INSTANCES)
    graph = stored(edges.join(sizes, "pattern"), "graph")
    direct = graph.where(F.col("kind") != NO_KIND).groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"), F.first("instances").alias("instances"))
    direct = stored(direct, "direct")
    free = graph.where(F.col("kind") == NO_KIND).select("pattern", "instance", "instances")
    share = direct.select("pattern", "kind", (F.col("seeds") / F.col("instances")).alias("score"))
    scores, zero = stored(share, "scores"), F.lit(0.0)
    for _ in range(ROUNDS):
        found = stored(free.join(scores.select("pattern", "kind", "score"), "pattern").groupBy("instance", "kind").agg(F.max("score").alias("found")), "found")
        gained = free.join(found, "instance").groupBy("pattern", "kind").agg((F.sum("found") * DAMPING / F.first("instances")).alias("score"))
        now = share.unionByName(gained).withColumn("before", zero).unionByName(scores.select("pattern", "kind", zero.alias("score"), F.col("score").alias("before")))
        older, scores = scores, stored(now.groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.sum("before").alias("before")), "scores")
        discard(older, found)
        if (scores.agg(F.max(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0) <= SETTLED:
            break
    best = scores.groupBy("pattern").agg(F.max(F.struct("score", (-F.col("kind")).alias("first"))).alias("b")).select("pattern", "b.score", (-F.col("b.first")).alias("stands"))
    seeds = direct.select("pattern", F.col("kind").alias("stands"), "seeds")
    return best.join(seeds, ["pattern", "stands"], "left").join(sizes, "pattern").select("pattern", "stands", "score", F.coalesce("seeds", F.lit(0)).cast("long").alias("seeds"), "instances")


def occurrences(text: Column) -> Column:
    """The patterns at every word of a text, candidate or not."""

    def of(words: Column) -> Column:
        at = lambda k: F.get(words, k)
        one = lambda w, k: F.array_compact(F.array(after_words(at(k - 1)), after_words(at(k - 2), at(k - 1)), before_word(at(k + 1))))
        return F.flatten(F.transform(words, one))

    return let(words_of(text), of)


def accepted(scored: DataFrame, words: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The patterns that extract, of ``scored`` ones, for candidate ``words`` of ``docs``."""
    good = scored.where((F.col("score") >= ACCEPT) & (F.col("seeds") >= MIN_SEEDS)).select("pattern", "score")
    good = broadcast_if_small(stored(good, "likely"), BROADCAST_PATTERNS)
    everywhere = docs.select(F.explode(occurrences(F.coalesce(F.col(text_col), F.lit("")))).alias("pattern"))
    everywhere = everywhere.join(good, "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("all"))
    here = words.select(F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi").groupBy("pattern").agg(F.count(F.lit(1)).alias("here"))
    sure = good.join(everywhere, "pattern").join(here, "pattern")
    return sure.where(F.col("score") * F.col("here") >= ACCEPT * F.col("all")).select("pattern")


def named(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*(F.lit(k) for k in (*KINDS, "id")))
    one = lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def joined(spans: Column) -> Column:
    """Ordered spans, those one blank apart as one."""
    firsts = F.filter(spans, lambda s, i: (i == 0) | (F.get(spans, i - 1)["end"] + 1 != s["start"]))
    lasts = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] != s["end"] + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["start"].alias("start"), a["kind"].alias("kind"), b["end"].alias("end")))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, n_found, flagged, base_sha256, spans."""
    rows = scan(docs, id_col, text_col)
    words = rows.select("row", F.explode("seen").alias("m")).select("row", "m.*")
    words = words.withColumn("patterns", F.array_compact(F.concat("before", F.array("behind"))))
    free, over = words.where(~F.col("covered")), met(rows, words.where("covered"))
    seeds = over.groupBy("row", "kind", "at", "instance").agg(F.min_by("before", "place").alias("before"), F.max_by("behind", "place").alias("behind"))
    seeds = seeds.select("instance", F.explode(F.array_compact(F.concat("before", F.array("behind")))).alias("pattern"), "kind")
    others = free.select("instance", F.explode("patterns").alias("pattern"), F.when(F.col("secret"), SECRET_KIND).otherwise(NO_KIND).alias("kind"))
    edges = stored(seeds.unionByName(others).groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "edges")
    good = broadcast_if_small(stored(accepted(score_graph(edges), words, docs, text_col), "accepted"), BROADCAST_PATTERNS)
    # candidates that follow each other stand under the words before the first of them too; that one is
    # extracted itself then, so only texts with an extracted word need their runs
    hit = free.select("row", F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi").select("row").distinct()
    hit = broadcast_if_small(stored(hit, "hit"), BROADCAST_PATTERNS)
    order = Window.partitionBy("row").orderBy("place")
    heads = F.when(~F.col("digit") | F.coalesce(F.lag("place").over(order) + 1 != F.col("place"), F.lit(True)), F.col("before"))
    led = free.join(hit, "row", "left_semi").withColumn("head", heads).withColumn("head", F.last("head", ignorenulls=True).over(order))
    led = led.select("row", "from", "to", F.explode(F.array_distinct(F.concat("patterns", "head"))).alias("pattern"))
    found = led.join(good, "pattern", "left_semi")
    span = F.struct(F.col("from").alias("start"), F.lit(len(KINDS)).alias("kind"), F.col("to").alias("end"))
    new = found.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("new")).select("row", joined(F.col("new")).alias("new"))
    base = F.transform("marks", lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    out = rows.select("row", "doc_id", base.alias("base")).join(stored(new, "new"), "row", "left")
    everything = F.array_sort(F.concat("base", F.coalesce("new", F.array().cast(SPANS))))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_found"),
        (F.size(everything) > 0).alias("flagged"),
        F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(everything).alias("spans"),
    )
