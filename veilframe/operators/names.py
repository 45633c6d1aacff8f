"""Names of persons in text, by a table of given names: a listed given name and the capitalised word after it.

``tokens`` is an index of the places where a name can stand: a capitalised word, with nothing but white space before the
next one. Places are exploded, and their offsets are running sums in a window over one text's places, so a text of any
length is sorted and summed, never copied. The table of names, of any size, is met by a join on the word, first for
different words alone, so that a word that fills the corpus is asked for once; the words that are names are
broadcast while they are few, checked by a count. The second word is looked up nowhere.

Null and empty texts, and null or blank names, find nothing; case of the names doesn't matter, repeated names count
once. Rows that repeat a key share their spans: give each text its own key. Words in capitals alone are no names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.patterns import PLACEHOLDER, SPACE, java
from veilframe.functions.text import category_of

_WORD = r"\p{Lu}\p{Ll}+"
#: A capitalised word, and in its group the white space and the capitalised word that must follow: not consumed, as that may be a given name too.
_PLACE = java(rf"{_WORD}(?=([{SPACE}]+{_WORD}))")
#: Different words that are names, up to which (some 50 bytes each) they are broadcast.
BROADCAST_ROWS = 500_000


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, end, given, value): each place where a name can stand, in code points; given is in lower case."""
    rows = docs.where(F.col(text).rlike(_PLACE)).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    found, rest = (F.regexp_extract_all("_text", F.lit(_PLACE), F.lit(g)) for g in (0, 1))
    parts = F.arrays_zip(F.split("_text", _PLACE, -1).alias("gap"), found.alias("given"), rest.alias("rest"))
    places = rows.select("_key", F.posexplode(parts).alias("n", "p")).where("p.given is not null")
    places = places.select("_key", "n", F.length("p.gap").alias("gap"), F.col("p.given").alias("given"), F.col("p.rest").alias("rest"))
    ahead = F.sum(F.col("gap") + F.length("given")).over(Window.partitionBy("_key").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = (ahead - F.length("given")).cast("int")
    return places.withColumn("_start", start).select(F.col("_key").alias(key), F.col("_start").alias("start"), (F.col("_start") + F.length("given") + F.length("rest")).alias("end"), F.lower("given").alias("given"), F.concat("given", "rest").alias("value"))


def known(found: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """The rows of ``found`` (given, ...) whose word is in the table ``names``."""
    table = names.select(F.lower(F.trim(name)).alias("given")).where("given <> ''").distinct()
    words = found.select("given").distinct().join(table, "given", "left_semi")
    few = words.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return found.join(F.broadcast(words) if few else words, "given", "left_semi")


def name_spans(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name: str = "name") -> DataFrame:
    """(doc_id, start, end, given, value) of each name of each text; spans may share a word ("Ada May Lovelace" holds two, if both are listed)."""
    return known(tokens(docs, key, text), names, name).select(key, "start", "end", "given", "value")


def categorised_with_names(rows: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name: str = "name") -> DataFrame:
    """``rows`` that hold personal data, with its category: what the rules of a text say, else ``name`` where one stands."""
    named = name_spans(rows, names, key, text, name).select(F.col(key).alias("_k")).distinct()
    told = rows.withColumn("category", category_of(F.coalesce(F.col(text), F.lit(""))))
    met = told.join(named.withColumn("_named", F.lit(True)), F.col(key) == F.col("_k"), "left")
    return met.withColumn("category", F.coalesce("category", F.when(F.col("_named"), F.lit("name")))).where("category is not null").select(*rows.columns, "category")


def _hidden(text: Column, values: Column) -> Column:
    """Every occurrence of every value, the longest first, replaced."""
    order = F.array_sort(F.transform(values, lambda v: F.struct((-F.length(v)).alias("long"), v.alias("v"))))
    return F.aggregate(order, text, lambda acc, x: F.replace(acc, x["v"], F.lit(PLACEHOLDER["name"])))


def scrubbed(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name: str = "name") -> DataFrame:
    """``docs`` with each found name replaced by its token, wherever the text holds it."""
    values = name_spans(docs, names, key, text, name).groupBy(F.col(key).alias("_k")).agg(F.collect_set("value").alias("_values"))
    met = docs.join(values, F.col(key) == F.col("_k"), "left")
    clean = F.when(F.col("_values").isNull(), F.col(text)).otherwise(_hidden(F.col(text), F.col("_values")))
    return met.withColumn(text, clean).select(*docs.columns)
