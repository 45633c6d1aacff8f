"""Personal data by fixed patterns, and by bootstrapped contexts, in DataFrame functions alone.

Base spans are the leftmost non-overlapping matches of four patterns, each kind for itself. The
expressions below find the same matches as the plain patterns stated beside them, but never scan a
run of characters more than once: quantifiers are possessive where nothing can be given back, and a
match may begin only at the start of a run or where the last match ended.

The contextual extraction starts from the base spans as seed entities. The two words before a seed
(at the start of a text, empty ones) induce a lexical pattern, which is kept if it has enough different
seeds. Instances are the words with an identifier's form (four or more digits, or an at sign) after such a
pattern, in all texts, and its seeds. Patterns and instances make a graph, and rounds of joins score it: a
pattern's score is the mean over the different values after it, a value's is 1 for seeds, 0 for words
without an identifier's form, and otherwise the noisy-or of its patterns'. Instances of a pattern that scores
``confident`` or more, and that no base span overlaps, are new spans of the kind ``context``.

Words without an identifier's form only count. They are counted in the texts with seeds first, for every
induced pattern. Where these alone keep a pattern from a score of ``confident``, its count stays; for all
others the words of all texts are counted. So patterns of everyday words score low and find nothing, and
the many places where they occur are never joined.

Offsets are code points, ends exclusive. Null texts count as empty and give no spans. Spans depend
on the text and the corpus alone: repeated rows get equal results, and no step needs unique ids.
Extra columns are not read, or passed through by ``redacted``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.shared import discard, written

_NAME = "A-Za-z0-9._%+-"
#: Fixed patterns by kind. Plain forms: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ for email,
#: [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) for ip, [0-9]([\x20-]?[0-9])+ for card and
#: \+[0-9][\x20().0-9-]+[0-9] for phone.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_NAME}]))[{_NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
TOKEN = {**{k: f"[{k.upper()}]" for k in KINDS}, "context": "[ID]"}

#: Different seeds that a pattern needs, its least score, rounds of scoring, and patterns up to which a table is broadcast.
SUPPORT, CONFIDENT, ROUNDS, BROADCAST_ROWS = 5, 0.8, 3, 50_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _holds(kind: str, x: Column) -> Column:
    """Whether a match of a kind's pattern counts."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return x.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(_digits(x)).between(16, 19) & F.call_function("luhn_check", _digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _cue(kind: str, text: Column) -> Column:
    """A quick test that all texts with a match of the kind pass."""
    return {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}[kind]


def _spans_of(kind: str, text: Column) -> Column:
    """ARRAY<STRUCT<kind, start, end, value>>: each match begins after the gaps and matches before it."""
    pattern = F.lit(PATTERNS[kind])
    matches, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    pairs = F.arrays_zip(gaps.alias("g"), matches.alias("m"))
    start = lambda acc, p: acc["at"] + F.length(p["g"])
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    step = lambda acc, p: F.struct(
        (start(acc, p) + F.length(p["m"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct(start(acc, p).alias("start"), (start(acc, p) + F.length(p["m"])).alias("end"), p["m"].alias("value")))).alias("out"),
    )
    found = F.aggregate(F.filter(pairs, lambda p: p["m"].isNotNull()), empty, step, lambda acc: acc["out"])
    kept = F.filter(found, lambda s: _holds(kind, s["value"]))
    named = F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    return F.when(_cue(kind, text), named).otherwise(none)


def base_spans(df: DataFrame, text: str = "text", into: str = "base") -> DataFrame:
    """Adds ``into``: the base spans, by kind as listed, then start."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(into, F.concat(*[_spans_of(kind, body) for kind in KINDS]))


BLANK = r"[\x20\x09-\x0D]+"
#: A word with an identifier's form, as found inside a text.
SHAPE = r"@|[0-9](?:[^0-9\x20\x09-\x0D]*[0-9]){3}"


def _shaped(value: str | Column = "value") -> Column:
    return F.contains(value, F.lit("@")) | (F.length(_digits(F.col(value) if isinstance(value, str) else value)) >= 4)


def _places(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, pattern, value): each word of ``text`` with the two words before it as a pattern."""
    rows = df.select(*keep, F.split("text", BLANK, -1).alias("w"))
    n, padded = F.size("w"), F.concat(F.array(F.lit(""), F.lit("")), F.col("w"))
    zipped = F.arrays_zip(F.slice(padded, 1, n).alias("a"), F.slice(padded, 2, n).alias("b"), F.col("w").alias("value"))
    return rows.select(*keep, F.inline(zipped)).where("value <> ''").select(*keep, _pattern().alias("pattern"), "value")


def _pattern(a: str | Column = "a", b: str | Column = "b") -> Column:
    return F.concat(F.lower(a), F.lit(" "), F.lower(b))


def _seed(value: Column, base: Column) -> Column:
    """Whether a base span begins in this word."""
    return F.exists(base, lambda s: F.startswith(value, F.substring_index(s["value"], " ", 1)) | F.contains(value, s["value"]))


def _small(df: DataFrame) -> DataFrame:
    """``df``, a written table, broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def seed_places(marked: DataFrame) -> DataFrame:
    """(pattern, value, seed): the different words in texts with base spans, and whether they are seeds. ``marked``: text, base.

    Values are counted once each, so copies of a text change nothing.
    """
    places = _places(marked.where(F.size("base") > 0), "base")
    seed = _seed(F.col("value"), F.col("base")).cast("int")
    return places.select("pattern", "value", seed.alias("seed")).groupBy("pattern", "value").agg(F.max("seed").alias("seed"))


def induced_patterns(places: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(pattern, others): patterns with at least ``support`` different seeds, and the number of different words after
    them in ``places`` that are neither seeds nor have an identifier's form."""
    counted = places.groupBy("pattern").agg(F.sum("seed").alias("seeds"), F.count_if((F.col("seed") == 0) & ~_shaped()).alias("others"))
    return counted.where(F.col("seeds") >= support).select("pattern", "others")


def scored_patterns(marked: DataFrame, places: DataFrame, patterns: DataFrame, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score, values, edges) of ``patterns``, with all texts of ``marked`` (text) and the seeds of ``places``.

    Seeds, and instances that one pattern alone precedes, whose score is that pattern's, are counts of the pattern. Only
    the other instances pass through the rounds of joins.
    """
    known = places.where("seed = 1").select("pattern", "value")
    induced = _small(patterns)
    formed = _places(marked.where(F.col("text").rlike(SHAPE))).where(_shaped())
    pairs = formed.union(known).join(induced, "pattern").select("pattern", "value").distinct()
    seeds = written(known.select("value").distinct(), "seeds")
    edges = written(pairs.join(seeds.select("value", F.lit(1).alias("seed")), "value", "left").select("pattern", "value", F.coalesce("seed", F.lit(0)).alias("seed")), "edges")
    values = edges.groupBy("value").agg(F.max("seed").alias("known"), F.count(F.lit(1)).alias("degree"))
    labelled = written(edges.select("pattern", "value").join(values, "value"), "labelled")
    own = ((F.col("known") == 0) & (F.col("degree") == 1)).cast("long")
    per_pattern = labelled.groupBy("pattern").agg(F.count(F.lit(1)).alias("edges"), F.sum("known").alias("seeds"), F.sum(own).alias("own"))
    counts = written(per_pattern.join(patterns, "pattern").select("*", (F.col("edges") + F.col("others")).alias("values")), "counts")
    hopeful = written(counts.where(F.col("edges") >= F.lit(confident) * F.col("values")).select("pattern"), "hopeful")
    if hopeful.limit(1).count():
        plain = _places(marked).join(_small(hopeful), "pattern").where(~_shaped()).select("pattern", "value").distinct()
        more = plain.join(seeds, "value", "left_anti").groupBy("pattern").agg(F.count(F.lit(1)).alias("all_others"))
        whole = counts.join(more, "pattern", "left").withColumn("values", F.greatest(F.col("values"), F.col("edges") + F.coalesce("all_others", F.lit(0))))
        counts = written(whole.drop("all_others"), "counts")
    shared = written(labelled.where("known = 0 and degree > 1").select("pattern", "value"), "shared")
    capped = F.least(F.col("score"), F.lit(0.999999))
    scores = written(counts.select("pattern", (F.col("seeds") / F.col("values")).alias("score")), "patterns")
    for _ in range(rounds - 1):
        doubt = F.exp(F.sum(F.log(F.lit(1.0) - capped)))
        belief = shared.join(_small(scores), "pattern").groupBy("value").agg((F.lit(1.0) - doubt).alias("belief"))
        sums = shared.join(belief, "value").groupBy("pattern").agg(F.sum("belief").alias("sum"))
        total = F.col("seeds") + F.col("own") * capped + F.coalesce("sum", F.lit(0.0))
        new = written(counts.join(scores, "pattern").join(sums, "pattern", "left").select("pattern", (total / F.col("values")).alias("score")), "patterns")
        discard(scores)
        scores = new
    found = written(scores.join(counts.select("pattern", "values", "edges"), "pattern"), "scored")
    for done in (seeds, edges, labelled, counts, hopeful, shared, scores):
        discard(done)
    return found


def context_spans(marked: DataFrame, confident: DataFrame) -> DataFrame:
    """(key, extra): per text with any, the instances after one of the ``confident`` patterns. ``marked``: key, text.

    A word's start is the sum of the words and the white space before it, a running sum over the words of each text that
    has such an instance.
    """
    texts = marked.where(F.col("text").rlike(SHAPE))
    hit = _places(texts, "key").where(_shaped()).join(_small(confident), "pattern").select("key").distinct()
    rows = texts.dropDuplicates(["key"]).join(_small(written(hit, "texts")), "key", "left_semi")
    words, gaps = F.split("text", BLANK, -1), F.concat(F.regexp_extract_all("text", F.lit(BLANK), F.lit(0)), F.array(F.lit("")))
    each = rows.select("key", F.posexplode(F.arrays_zip(words.alias("word"), gaps.alias("gap"))).alias("pos", "x")).select("key", "pos", "x.*")
    order = Window.partitionBy("key").orderBy("pos")
    ahead = F.sum(F.length("word") + F.length("gap")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    before = lambda n: F.coalesce(F.lag("word", n).over(order), F.lit(""))
    placed = each.select("key", "word", F.coalesce(ahead, F.lit(0)).cast("int").alias("at"), _pattern(before(2), before(1)).alias("pattern")).where(_shaped("word"))
    lead = F.length(F.regexp_extract("word", r"^([^0-9A-Za-z@+]*)", 1))
    long = F.length(F.regexp_extract("word", r"^[^0-9A-Za-z@+]*(.*?)[^0-9A-Za-z]*$", 1))
    found = placed.join(_small(confident), "pattern").select("key", (F.col("at") + lead).alias("start"), long.alias("long")).where("long > 0")
    span = F.struct(F.lit("context").alias("kind"), "start", (F.col("start") + F.col("long")).alias("end"))
    return found.groupBy("key").agg(F.array_sort(F.collect_set(span)).alias("extra"))  # one text's own words


def detected(docs: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``extra``, the spans by pattern and by context.

    Texts are told apart by their SHA-256 digest. The corpus is read for its seeds, again for the instances of induced
    patterns if there are any, for the other words of those that may be confident, and for new spans if any is.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(body.alias("text"))
    places = written(seed_places(base_spans(texts, "text")), "places")
    patterns = written(induced_patterns(places, support), "induced")
    extra = None
    if patterns.limit(1).count():
        scores = scored_patterns(texts, places, patterns, confident)
        sure = written(scores.where(F.col("score") >= confident).select("pattern"), "confident")
        discard(scores)
        if sure.limit(1).count():
            extra = written(context_spans(texts.select(F.sha2("text", 256).alias("key"), "text"), sure), "context")
    for done in (places, patterns):
        discard(done)
    out = base_spans(docs, text, "base")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    if extra is None:
        return out.withColumn("extra", none)
    keyed = out.withColumn("_key", F.sha2(body, 256))
    joined = keyed.join(_small(extra).withColumnRenamed("key", "_found"), F.col("_key") == F.col("_found"), "left")
    clear = F.filter("extra", lambda x: ~F.exists("base", lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"])))
    return joined.withColumn("extra", F.coalesce(clear, none)).drop("_key", "_found")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: base spans by kind, their digest, and all spans."""
    found = detected(docs.select("doc_id", "text"), **options)
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    every = F.concat_ws(",", F.when(F.size("base") > 0, listed(F.col("base"))), F.when(F.size("extra") > 0, listed(F.col("extra"))))
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), every.alias("spans"))


def redacted(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by a token of its kind; of spans that overlap, the first in order of start, longest first, is replaced whole with all that overlap it."""
    found = detected(docs.withColumnsRenamed({c: f"_own_{c}" for c in ("base", "extra") if c in docs.columns}), text=text, **options)
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))
    more = F.transform("extra", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind")))
    token = lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in TOKEN.items() for x in kv]), s["kind"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        cut = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), F.when(fresh, F.concat(acc["out"], cut, token(s))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text))))
    rebuilt = F.aggregate(F.array_sort(F.concat(plain, more)), start, step, rest)
    changed = F.when((F.size("base") > 0) | (F.size("extra") > 0), rebuilt).otherwise(F.col(text))
    named = {c: (f"_own_{c}" if c in ("base", "extra") else c) for c in docs.columns}
    return found.select(*[changed.alias(text) if c == text else F.col(n).alias(c) for c, n in named.items()])
