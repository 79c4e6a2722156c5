"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

A text becomes a sequence of template tokens: numbers, names and units turn into typed placeholders, other words into
lower case.  Windows of ``WINDOW`` template tokens of documents and benchmark items are hash-joined.  Matches of a
document and an item with the same shift between their positions form an alignment; it counts if at least
``MIN_WINDOWS`` windows match (all, if the item has fewer that say enough) and its slots are consistent: one value of the item always
stands for one value of the document.  So both copied and re-parameterised questions are found.

Tokens are numbers (with inner points and commas) and runs of letters.  A name is a word of two letters or more with a
capital A-Z followed by lower case that does not begin a sentence; a unit is one of ``UNITS`` after a number.  Windows
with fewer than ``MIN_WORDS`` plain words match anything of that shape and are left out; only if an item has no
others, those with a plain word count where the document has the same written values.  Items with fewer than
``WINDOW`` tokens match as a whole: as written but for case, or by their template if it has ``MIN_WORDS`` plain words.
Items of numbers alone never match.  Benchmark windows are broadcast only if there are at most ``BROADCAST_WINDOWS``, else
the join is shuffled.

Null and empty texts of documents or items have no windows.  Rows with equal doc_id and text are one document, rows
with equal item_id one item each text; a null doc_id or item_id is a value like any other.  Empty tables give an empty
result.  Extra columns are ignored here and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize

WINDOW, MIN_WINDOWS, MIN_WORDS = 8, 3, 5
#: Rows of 32 bytes and their slots: some 20 MB.
BROADCAST_WINDOWS = 200_000
#: doc keys of 16 bytes: some 10 MB.
BROADCAST_KEYS = 500_000
#: Fixed list of unit words and signs made of letters.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year "
    "meters metres meter metre kilometers kilometres miles mile feet foot inches inch grams gram kilograms pounds pound liters litres dollars dollar "
    "cents cent euros euro percent degrees kmh mph"
).split()
TOKEN = r"""(?:[.!?:\n][ \t\r\n"']*)?(?:[0-9]+(?:[.,][0-9]+)*|\p{L}+)"""
#: What a token may begin with if it begins a sentence.
BREAKS = ".!?:\n \t\r\"'"


def _once(df: DataFrame, name: str, value) -> DataFrame:
    """``value`` as a column behind a generator, which keeps the optimizer from copying it into each use."""
    return df.withColumn(name, F.explode(F.array(value)))


def template(df: DataFrame) -> DataFrame:
    """Adds _word (tokens as written) and _kind (hash of each template token; placeholders are the smallest)."""
    df = _once(df, "_raw", F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKEN), F.lit(0)))
    df = _once(df, "_word", F.transform("_raw", lambda x: F.ltrim(x, F.lit(BREAKS))))

    def canonical(w, i):
        lower = F.lower(w)
        capital = (w < "[") & (i > 0) & (w == F.get("_raw", i)) & (F.length(w) > 1) & (F.substring(w, 2, 1 << 20) == F.substring(lower, 2, 1 << 20))
        unit = (i > 0) & (F.get("_word", i - 1) < ":") & lower.isin(UNITS)  # few tokens come after a number
        return F.when(w < ":", "#").when(capital, "@").when(unit, "%").otherwise(lower)

    return _once(df, "_kind", F.transform("_word", canonical)).drop("_raw")


def _hashable(df: DataFrame) -> tuple[DataFrame, Column]:
    """Texts with a window at least, with _ids, and the hashes of the template tokens of their windows, in order."""
    n = F.size("_kind") - WINDOW + 1
    df = _once(df, "_ids", F.transform("_kind", lambda x: F.xxhash64(x)))
    return df.where(n > 0), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get("_ids", i + k) for k in range(WINDOW))))


def windows(df: DataFrame) -> DataFrame:
    """One row for each window: _at its position, _hash of its template tokens."""
    df, hashes = _hashable(df)
    return df.select("*", F.posexplode(hashes).alias("_at", "_hash")).drop("_ids")


def _same(doc: str, text: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("text_hash") == F.col(text))


def _meet(docs: DataFrame, keyed, items: DataFrame, key: str) -> DataFrame:
    """doc_id, text_hash and _word of documents, _at and the columns of ``items`` of all positions with an item's ``key``.

    ``keyed`` gives a templated frame and its array of keys.  Only keys and positions are exploded, never a text's tokens:
    a row for each window that carried these would cost the square of a text's length.  Documents with hits are then
    read once more.  Few items are broadcast, else the keys are shuffled.
    """
    df, hashes = keyed(template(docs).drop("text"))
    at = df.select("doc_id", "text_hash", F.posexplode(hashes).alias("_at", key))
    found = at.join(F.broadcast(items) if items.count() <= BROADCAST_WINDOWS else items, key).distinct()
    hits = materialize(found, "hits").withColumnsRenamed({"doc_id": "_doc", "text_hash": "_text"})
    hit = hits.select(F.col("_doc").alias("_hit"), F.col("_text").alias("_hit_text")).distinct()
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_KEYS else hit
    texts = template(docs.join(hit, _same("_hit", "_hit_text"), "left_semi")).select("doc_id", "text_hash", "_word")
    return texts.join(hits, _same("_doc", "_text"))


def _slots():
    """(offset, kind, value) of each placeholder of the window from _at, as far as there are tokens."""
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda k: F.get("_kind", F.col("_at") + k).isin("#", "@", "%")),
        lambda k: F.struct(k.alias("k"), F.get("_kind", F.col("_at") + k).alias("kind"), F.lower(F.get("_word", F.col("_at") + k)).alias("value")),
    )


def _items(benchmark: DataFrame) -> DataFrame:
    return template(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct())


def item_windows(benchmark: DataFrame) -> DataFrame:
    """_hash, item_id, _ipos, _n (windows of the item), _need (that have to match), _slots and _exact (whether their values have to be the same)."""
    rows = windows(_items(benchmark))
    rows = rows.select("_hash", "item_id", F.xxhash64("text").alias("_item"), F.col("_at").alias("_ipos"), (F.size("_kind") - WINDOW + 1).alias("_n"), _slots().alias("_slots"))
    rows = rows.where(F.size("_slots") < WINDOW).withColumn("_exact", F.size("_slots") > WINDOW - MIN_WORDS)
    # an item's windows are at most its own tokens
    item = Window.partitionBy("item_id", "_item")
    rows = rows.withColumn("_some", F.min("_exact").over(item)).where("_exact = _some").drop("_some")
    return rows.withColumn("_need", F.least(F.lit(MIN_WINDOWS), F.count("*").over(item)))


def whole_items(benchmark: DataFrame) -> DataFrame:
    """_width, _template, _key, item_id, _item, _slots of items with fewer than WINDOW tokens: once as written, once as template if that says enough."""
    rows = _items(benchmark).where((F.size("_word") > 0) & (F.size("_word") < WINDOW) & F.exists("_word", lambda w: w >= ":"))
    rows = rows.withColumn("_at", F.lit(0)).withColumn("_width", F.size("_word"))
    slots = _slots()
    says = (F.size(slots) > 0) & (F.col("_width") - F.size(slots) >= MIN_WORDS)
    written = rows.select("_width", F.lit(False).alias("_template"), _key("_word", F.lit(0), F.col("_width")).alias("_key"), "item_id", F.xxhash64("text").alias("_item"), slots.alias("_slots"))
    return written.union(rows.where(says).select("_width", F.lit(True), _key("_kind", F.lit(0), F.col("_width")), "item_id", F.xxhash64("text"), slots))


def _key(tokens: str, at, width):
    return F.xxhash64(F.transform(F.slice(tokens, at + 1, width), lambda x: F.lower(x)))


def _keys(tokens: str, width: int):
    return F.transform(F.sequence(F.lit(0), F.size(tokens) - width), lambda i: _key(tokens, i, F.lit(width)))


def _one_to_one(pairs):
    return F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["kind"], p["ours"]))))


def _pairs(at):
    return F.transform("_slots", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("ours"), F.lower(F.get("_word", at + s["k"])).alias("theirs")))


def _changed(pairs):
    return F.size(F.filter(pairs, lambda p: p["ours"] != p["theirs"]))


def _whole(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold one of ``whole_items``, as rows like those of ``contaminated``."""
    found = None
    for width, by_template in sorted(tuple(r) for r in items.select("_width", "_template").distinct().collect()):  # 10 at most
        mine = items.where((F.col("_width") == width) & (F.col("_template") == by_template))
        keys = _keys("_kind" if by_template else "_word", width)
        met = _meet(docs, lambda df, keys=keys, width=width: (df.where(F.size("_word") >= width), keys), mine, "_key")
        met = met.withColumn("_pairs", F.array_distinct(_pairs(F.col("_at"))))
        met = met.where(_one_to_one(F.col("_pairs"))) if by_template else met
        changed = _changed(F.col("_pairs")) if by_template else F.lit(0)
        met = met.select("doc_id", "text_hash", "item_id", F.lit(1).cast("long").alias("n_windows"), F.lit(1).alias("_n"), changed.alias("changed"))
        found = met if found is None else found.union(met)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, n_windows, item_windows, changed_slots of each document and item that match."""
    bench = materialize(item_windows(benchmark), "benchmark-windows")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    met = _meet(rows, _hashable, bench, "_hash").withColumn("_pairs", _pairs(F.col("_at"))).where(~F.col("_exact") | (_changed(F.col("_pairs")) == 0))
    met = met.select("doc_id", "text_hash", "item_id", "_item", "_n", "_need", "_ipos", (F.col("_at") - F.col("_ipos")).alias("_shift"), "_pairs")
    # an alignment has at most the item's windows, so its sets are bounded by the item
    lined = met.groupBy("doc_id", "text_hash", "item_id", "_item", "_n", "_need", "_shift").agg(
        F.count_distinct("_ipos").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set("_pairs"))).alias("_pairs")
    )
    lined = lined.where((F.col("n_windows") >= F.col("_need")) & _one_to_one(F.col("_pairs")))
    lined = lined.select("doc_id", "text_hash", "item_id", "n_windows", "_n", _changed(F.col("_pairs")).alias("changed"))
    whole = materialize(whole_items(benchmark), "benchmark-items")
    if not whole.isEmpty():
        lined = lined.union(_whole(rows, whole))
    return lined.groupBy("doc_id", "text_hash", "item_id").agg(
        F.max("n_windows").cast("long").alias("n_windows"), F.max("_n").cast("long").alias("item_windows"), F.min("changed").cast("long").alias("changed_slots")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all other rows with all their columns."""
    found = materialize(contaminated(docs, benchmark).select(F.col("doc_id").alias("_ss_id"), F.col("text_hash").alias("_ss_text")).distinct(), "contaminated")
    if found.count() <= BROADCAST_KEYS:
        found = F.broadcast(found)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_ss_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_ss_text"))
    return docs.join(found, same, "left_anti")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_windows", "item_windows", "changed_slots")


_UNIT_LIST = ", ".join(f"'{u}'" for u in UNITS)
_SQL_TOKEN = TOKEN.replace("'", "''")
_SQL_BREAKS = BREAKS.replace("'", "''")
_KINDS = f"""list_transform(word, lambda w, i: CASE WHEN w < ':' THEN '#'
  WHEN w < '[' AND i > 1 AND w = raw[i] AND length(w) > 1 AND substring(w, 2) = substring(lower(w), 2) THEN '@'
  WHEN lower(w) IN ({_UNIT_LIST}) AND i > 1 AND word[i - 1] < ':' THEN '%' ELSE lower(w) END)"""


def _sql_windows(table: str, key: str) -> str:
    return f"""SELECT {key}, text, word, kind, unnest(generate_series(1, len(kind) - {WINDOW - 1})) AS pos FROM (
  SELECT *, {_KINDS} AS kind FROM (SELECT *, list_transform(raw, lambda x: ltrim(x, E'{_SQL_BREAKS}')) AS word FROM (
    SELECT DISTINCT {key}, text, regexp_extract_all(coalesce(text, ''), E'{_SQL_TOKEN.replace(chr(92), chr(92) * 2)}') AS raw FROM {table})))"""


OP6_SQL = f"""
WITH d AS (SELECT doc_id, text, word, pos, array_to_string(kind[pos : pos + {WINDOW - 1}], ' ') AS w FROM ({_sql_windows("documents", "doc_id")})),
b AS (SELECT item_id, text, word, pos, len(kind) - {WINDOW - 1} AS n, kind[pos : pos + {WINDOW - 1}] AS ks, array_to_string(kind[pos : pos + {WINDOW - 1}], ' ') AS w
  FROM ({_sql_windows("benchmark", "item_id")})),
m AS (SELECT d.doc_id, d.text, b.item_id, b.text AS item, b.n, b.pos AS ipos, d.pos - b.pos AS shift,
  list_transform(list_filter(range(0, {WINDOW}), lambda k: b.ks[k + 1] IN ('#', '@', '%')), lambda k: {{'kind': b.ks[k + 1], 'ours': lower(b.word[b.pos + k]), 'theirs': lower(d.word[d.pos + k])}}) AS pairs
  FROM d JOIN b ON d.w = b.w WHERE len(list_filter(b.ks, lambda k: k IN ('#', '@', '%'))) <= {WINDOW - MIN_WORDS}),
l AS (SELECT doc_id, text, item_id, item, n, shift, count(DISTINCT ipos) AS k, list_distinct(flatten(list(pairs))) AS pairs FROM m GROUP BY ALL),
g AS (SELECT *, len(list_filter(pairs, lambda p: p.ours <> p.theirs)) AS changed FROM l
  WHERE k >= least({MIN_WINDOWS}, n) AND len(pairs) = len(list_distinct(list_transform(pairs, lambda p: {{'kind': p.kind, 'ours': p.ours}}))))
SELECT doc_id, item_id, max(k)::BIGINT AS n_windows, max(n)::BIGINT AS item_windows, min(changed)::BIGINT AS changed_slots
FROM g GROUP BY doc_id, text, item_id
"""
