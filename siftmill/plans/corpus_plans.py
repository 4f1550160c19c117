"""Queries over corpora: deduplication, sampling, splits, contamination, schema graph, packing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sqlfeat, text
from ..operators import cross, dedup, pack, sample, schema_graph
from ..sources import jsonl
from .fixtures import FKS, SQLS, chats, evals, fks, sqls, table

_FOLDED = "regexp_replace(trim(lower(coalesce(text, ''))), '\\s+', ' ', 'g')"
_H = "sha256(concat_ws('|', '42', CAST(doc_id AS VARCHAR)))"
_N = "CAST(count(*) AS BIGINT)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def dedup_exact(spark, sf_dir):
    """md5 of the lower-cased trimmed text, first row kept."""
    key = F.md5(F.lower(F.trim(F.coalesce("text", F.lit("")))).cast("binary"))
    return dedup.first_of(_docs(spark, sf_dir).select("doc_id", "source", key.alias("key")), F.col("key"), "doc_id").select("doc_id", "source")


def dedup_ws(spark, sf_dir):
    """As D1 with white space folded."""
    return dedup.first_of(_docs(spark, sf_dir).select("doc_id", "source", text.fingerprint("text").alias("key")), F.col("key"), "doc_id").select("doc_id", "source")


def dedup_history(spark, sf_dir):
    """D3: against history and within the batch, with the reason of each reject."""
    d = _docs(spark, sf_dir).select("doc_id", "lang", text.fingerprint("text").alias("fp"))
    return dedup.reject_reasons(d.where("lang <> 'en'"), d.where("lang = 'en'"), "fp", "doc_id").select("doc_id", "reject_reason")


def first_seen(spark, sf_dir):
    """Two sources merged, of equal folded texts the first by source rank and position."""
    d = _docs(spark, sf_dir).select("doc_id", "source", "lang", text.fingerprint("text").alias("k"))
    two = d.where("lang <> 'en'").withColumn("rank", F.lit(0)).unionByName(d.withColumn("rank", F.lit(1)))
    return dedup.first_of(two, F.col("k"), "rank", "doc_id").select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


def dedup_counters(spark, sf_dir):
    """A13."""
    r = dedup_history(spark, sf_dir)
    return r.agg(F.count("*").alias("seen"), F.count_if(F.col("reject_reason") == "history").alias("history"), F.count_if(F.col("reject_reason") == "batch").alias("batch"), F.count_if(F.col("reject_reason").isNull()).alias("kept"))


def jaccard_pairs(spark, sf_dir):
    """Benchmark items by overlap of their key tokens with the next item's."""
    b = table(spark, sf_dir, "benchmark").select("item_id", text.key_tokens("text").alias("t"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return b.join(nxt, "item_id").select("item_id", text.jaccard(F.col("t"), F.col("u")).alias("overlap"))


def overlap_benchmark(spark, sf_dir):
    """Documents that hold an eight-word run of a benchmark item, by equi-join on the run."""
    grams = lambda c: F.expr(f"transform(sequence(0, greatest(size({c}) - 8, 0)), i -> array_join(slice({c}, i + 1, 8), ' '))")
    b = table(spark, sf_dir, "benchmark").select("item_id", text.tokenize("text").alias("t")).where(F.size("t") >= 8).select("item_id", F.explode(F.array_distinct(grams("t"))).alias("g"))
    d = _docs(spark, sf_dir).select("doc_id", text.tokenize("text").alias("t")).where(F.size("t") >= 8).select("doc_id", F.explode(F.array_distinct(grams("t"))).alias("g"))
    return d.join(b, "g").groupBy("doc_id", "item_id").agg(F.count("*").alias("runs"))


def _grams(c: str) -> str:
    return f"list_distinct(list_transform(range(0, len({c}) - 7), lambda i: array_to_string(list_slice({c}, i + 1, i + 8), ' ')))"


_OVERLAP_SQL = f"""WITH b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents),
x AS (SELECT item_id, unnest({_grams('t')}) AS g FROM b WHERE len(t) >= 8), y AS (SELECT doc_id, unnest({_grams('t')}) AS g FROM d WHERE len(t) >= 8)
SELECT doc_id, item_id, {_N} AS runs FROM x JOIN y USING (g) GROUP BY doc_id, item_id"""

_KIND = "CASE doc_id % 5 WHEN 0 THEN 'real_failure' WHEN 1 THEN 'synthetic_corruption' WHEN 2 THEN 'contrastive' WHEN 3 THEN 'manual_fix' ELSE 'other' END"
_ROUTED_SQL = f"""SELECT doc_id, {_KIND} AS kind, CASE WHEN doc_id % 7 = 0 THEN 't10_run' ELSE 'local' END AS run, source IN ('src0', 'src1', 'src2') AS bench, CASE WHEN doc_id % 3 = 0 THEN 'gold' ELSE 'made' END AS ref,
  CASE WHEN doc_id % 4 = 0 THEN 'prediction' ELSE '' END AS broken, doc_id % 6 = 0 AS outside, doc_id % 13 <> 0 AS passed, doc_id % 17 <> 0 AS valid, doc_id % 19 <> 0 AS complete FROM documents"""


def _routed(spark, sf_dir):
    d = _docs(spark, sf_dir)
    i = F.col("doc_id")
    d = d.select(
        "doc_id", F.expr(_KIND).alias("kind"), F.when(i % 7 == 0, "t10_run").otherwise("local").alias("run"), F.col("source").isin("src0", "src1", "src2").alias("bench"), F.when(i % 3 == 0, "gold").otherwise("made").alias("ref"),
        F.when(i % 4 == 0, "prediction").otherwise("").alias("broken"), (i % 6 == 0).alias("outside"), (i % 13 != 0).alias("passed"), (i % 17 != 0).alias("valid"), (i % 19 != 0).alias("complete"),
    )
    c = F.col
    d = d.withColumn("origin", sqlfeat.contamination_source(c("kind"), c("run"), c("bench"), c("ref"), c("broken"), c("outside")))
    where = (c("origin"), c("passed"), c("valid"), c("complete"))
    return d.withColumns({"pool": sqlfeat.pool(*where), "reason": sqlfeat.route_reason(*where), "risk": sqlfeat.risk(c("origin"))})


def contamination_route(spark, sf_dir):
    return _routed(spark, sf_dir).select("doc_id", "origin", "pool", "reason", "risk")


_ROUTE = f"""r AS ({_ROUTED_SQL}), o AS (SELECT *, CASE WHEN kind = 'real_failure' AND (run = 't10_run' OR bench) THEN 'bird_dev_direct' WHEN ref = 'gold' AND bench THEN 'bird_gold_reference' WHEN broken = 'prediction' AND bench THEN 'bird_prediction_broken'
  WHEN kind = 'synthetic_corruption' AND outside THEN 'non_benchmark' WHEN kind = 'synthetic_corruption' AND bench THEN 'bird_gold_reference' WHEN kind IN ('contrastive', 'manual_fix', 'deterministic_fix') AND (outside OR NOT bench) THEN 'non_benchmark'
  WHEN bench THEN 'bird_dev_direct' ELSE 'non_benchmark' END AS origin FROM r),
p AS (SELECT doc_id, origin, CASE WHEN NOT passed OR NOT valid OR NOT complete THEN 'rejected' WHEN origin = 'non_benchmark' THEN 'clean' ELSE 'internal' END AS pool,
  CASE WHEN NOT passed THEN 'Validation failed' WHEN NOT valid THEN 'Reference SQL invalid or missing' WHEN NOT complete THEN 'Missing required metadata fields' WHEN origin = 'non_benchmark' THEN 'Clean source: ' || origin ELSE 'Benchmark-derived: ' || origin END AS reason,
  CASE WHEN origin = 'non_benchmark' THEN 'none' ELSE 'high' END AS risk FROM o)"""


def routing_counts(spark, sf_dir):
    """A12."""
    return _routed(spark, sf_dir).groupBy("pool", "reason").agg(F.count("*").alias("n"))


def cross_pool_leak(spark, sf_dir):
    """All pairs of a user's and an assistant's turn that are at least 0.8 similar."""
    d = _turns(spark, sf_dir)
    pairs = cross.cross_pairs(*(d.where(F.col("role") == p).select("id", "t") for p in ("user", "assistant")))
    return pairs.select(F.col("a").alias("user_id"), F.col("b").alias("assistant_id"), F.round("ratio", 3).alias("ratio")).distinct()


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", F.concat_ws("/", "conv_id", "turn").alias("id"), "role", text.folded("text").alias("t"))


def edited_pool_leak(spark, sf_dir):
    """The users' turns against the assistants' and, for every tenth conversation, the users' without their end."""
    d = _turns(spark, sf_dir)
    user = d.where("role = 'user'")
    cut = user.where("conv_id % 10 = 0").select(F.concat(F.lit("cut/"), "id").alias("id"), F.expr("trim(substring(t, 1, length(t) - 10))").alias("t"))
    pairs = cross.cross_pairs(user.select("id", "t"), d.where("role = 'assistant'").select("id", "t").unionByName(cut))
    return pairs.select("a", "b", F.round("ratio", 3).alias("ratio")).distinct()


def neardup_greedy(spark, sf_dir):
    """D8 over whole benchmark items."""
    return dedup.greedy_near_dedup(table(spark, sf_dir, "benchmark").withColumn("pool", F.lit("items")), "pool", "item_id", "text")


def stratified_split(spark, sf_dir):
    return sample.stratified_split(_docs(spark, sf_dir).select("doc_id", "source", "lang"), ["source", "lang"], "doc_id").select("doc_id", "split")


def quota_shortfall(spark, sf_dir):
    return sample.quota_shortfall(_docs(spark, sf_dir), "lang", {"en": 700, "fr": 150, "de": 500, "xx": 10})


def roundrobin_subset(spark, sf_dir):
    return sample.round_robin(_docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 2, 70).select("doc_id", "source")


def hash_rebalance(spark, sf_dir):
    """M6: rows beyond 20 of a source go to train or dev by hash fraction."""
    d = _docs(spark, sf_dir).select("doc_id", "source")
    h = sample.keyed_hash(42, F.col("doc_id"))
    ranked = sample.ranked(d, ["source"], h, "doc_id")
    return ranked.select("doc_id", F.when(F.col("rk") <= 20, "test").when(sample.unit_hash(h) < 0.814, "train").otherwise("dev").alias("split"))


def hash_modes(spark, sf_dir):
    """Compact or full by hash."""
    h = sample.keyed_hash(42, F.col("doc_id"))
    return _docs(spark, sf_dir).select("doc_id", F.when(sample.bucket_100(h) < 55, "compact").otherwise("full").alias("mode"))


def exact_cut(spark, sf_dir):
    """90/5/5 by hash rank over all rows, with a capped tail."""
    d = _docs(spark, sf_dir).select("doc_id")
    total = d.agg(F.count("*").alias("n"))
    h = sample.keyed_hash(42, F.col("doc_id"))
    # Ranks over all rows without one global window: ranks inside hash prefixes plus the prefix's offset.
    p = d.withColumn("h", h).withColumn("p", F.substring("h", 1, 2))
    sizes = p.groupBy("p").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = p.withColumn("rk", F.row_number().over(Window.partitionBy("p").orderBy("h", "doc_id"))).join(F.broadcast(sizes.select("p", "before")), "p").withColumn("rk", F.col("rk") + F.col("before"))  # 256 prefixes
    r = r.crossJoin(F.broadcast(total))  # one row
    return r.select("doc_id", F.when(F.col("rk") <= F.floor(F.col("n") * 0.9), "train").when(F.col("rk") <= F.floor(F.col("n") * 0.95), "dev").otherwise("test").alias("split"), (F.col("rk") > F.col("n") - F.least(F.lit(800), F.floor(F.col("n") * 0.06))).alias("capped_dev"))


def upsample_plan(spark, sf_dir):
    d = sqls(spark, sf_dir)
    return sample.upsample_plan(d, sqlfeat.strict_features("sql")["CTE"], 0.25)


def upsampled(spark, sf_dir):
    """M9: rows and their multiplicity after upsampling."""
    d = sqls(spark, sf_dir).select("doc_id", sqlfeat.strict_features("sql")["CTE"].alias("cte"))
    extra = sample.upsample_plan(d, F.col("cte"), 0.25).first()["extra"]
    return sample.upsample(d, F.col("cte"), "doc_id", extra).groupBy("doc_id").agg(F.count("*").alias("times"))


def undersample(spark, sf_dir):
    return sample.capped(_docs(spark, sf_dir).select("doc_id", "lang"), ["lang"], 100, sample.keyed_hash(42, F.col("doc_id")), "doc_id")


def capped_accept(spark, sf_dir):
    """The first rows of each family up to its share of 90."""
    d = _docs(spark, sf_dir).select("doc_id", "source")
    families = d.select("source").distinct().count()
    return sample.capped(d, ["source"], 90 // max(1, families), "doc_id")


def sampling_weight(spark, sf_dir):
    d = _routed(spark, sf_dir)
    w = sqlfeat.sampling_weight(F.col("kind"), F.col("doc_id") % 2 == 0, F.when(F.col("bench"), 2).otherwise((F.col("doc_id") % 2).cast("int")))
    return d.select("doc_id", w.alias("weight"))


def largest_remainder(spark, sf_dir):
    t = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("total"))
    return sample.largest_remainder(t, "source", "total", {"train": 80, "dev": 10, "test": 10})


def deficit(spark, sf_dir):
    t = _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("have"))
    return t.select("source", F.greatest(F.lit(0).cast("long"), 52 - F.col("have")).alias("missing")).orderBy(F.desc("missing"), "source").limit(10)


def alignment(spark, sf_dir):
    """tables that a text names and the catalogue lacks."""
    known = spark.createDataFrame([(f"src{k}",) for k in range(0, 20, 2)] + [("orders",), ("part",)], "known string")
    used = sqls(spark, sf_dir).select("doc_id", F.explode(text.source_tables("sql")).alias("name")).where(~F.col("name").rlike("^t[0-9]+$") & ~F.col("name").isin("subquery", "sub", "temp"))
    return used.join(F.broadcast(known), F.col("name") == F.col("known"), "left_anti")  # a literal table


_USED = f"WITH {SQLS}, u AS (SELECT DISTINCT doc_id, unnest(list_transform(regexp_extract_all(sql, '(?i)\\b(?:FROM|JOIN)\\s+`?(\\w+)`?', 1), lambda x: lower(x))) AS name FROM sqls)"


def fk_paths(spark, sf_dir):
    return schema_graph.paths(schema_graph.undirected(fks(spark, sf_dir)), 6).select("src", "dst", F.col("hops").cast("long").alias("hops"), "path")


_PATHS_SQL = f"""WITH RECURSIVE {FKS}, e AS (SELECT DISTINCT a, b FROM (SELECT src_t AS a, dst_t AS b FROM fks UNION ALL SELECT dst_t, src_t FROM fks)),
w(src, dst, hops, path, seen) AS (SELECT a, b, 1, a || '>' || b, [a, b] FROM e UNION ALL SELECT w.src, e.b, w.hops + 1, w.path || '>' || e.b, list_append(w.seen, e.b) FROM w JOIN e ON w.dst = e.a WHERE NOT list_contains(w.seen, e.b) AND w.hops < 6),
r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY hops, path) AS k FROM w)
SELECT src, dst, CAST(hops AS BIGINT) AS hops, path FROM r WHERE k = 1"""


def nhop(spark, sf_dir):
    return schema_graph.neighbourhood(schema_graph.undirected(fks(spark, sf_dir)), ["supplier"], 2).select("table_name", F.col("distance").cast("long").alias("distance"))


def bridge_tables(spark, sf_dir):
    return schema_graph.bridges(schema_graph.undirected(fks(spark, sf_dir)), ["customer", "supplier", "orders", "part"])


_EDGES = f"{FKS}, e AS (SELECT DISTINCT a, b FROM (SELECT src_t AS a, dst_t AS b FROM fks UNION ALL SELECT dst_t, src_t FROM fks))"
_COLUMNS = [("orders", "o_orderkey", 1, 0), ("orders", "o_custkey", 0, 1), ("orders", "o_totalprice", 0, 0), ("orders", "o_orderdate", 0, 0), ("customer", "c_custkey", 1, 0), ("customer", "c_mktsegment", 0, 0), ("part", "p_partkey", 1, 0), ("part", "p_retail_price", 0, 0)]


def column_score(spark, sf_dir):
    """Relevance of columns to each benchmark-like question."""
    cols = spark.createDataFrame(_COLUMNS, "table_name string, column_name string, pk int, fk int")
    q = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("which orderdate and retail price of o_totalprice in "), F.lower("lang"), F.when(F.col("doc_id") % 2 == 0, " with c_mktsegment").otherwise("")).alias("q"))
    x = q.join(F.broadcast(cols))  # eight literal rows
    s = schema_graph.column_score(F.col("column_name"), F.col("pk") == 1, F.col("fk") == 1, F.col("column_name") == "o_custkey", F.col("q"))
    return x.select("doc_id", "table_name", "column_name", s.cast("long").alias("score"))


_SCORE_SQL = f"""WITH c(table_name, column_name, pk, fk) AS (VALUES {", ".join(str(c) for c in _COLUMNS)}), q AS (SELECT doc_id, 'which orderdate and retail price of o_totalprice in ' || lower(lang) || CASE WHEN doc_id % 2 = 0 THEN ' with c_mktsegment' ELSE '' END AS q FROM documents)
SELECT doc_id, table_name, column_name, CAST(10 * len(list_filter(string_split(column_name, '_'), lambda w: length(w) > 3 AND contains(q, w))) + 100 * pk + 90 * fk + CASE WHEN column_name = 'o_custkey' THEN 80 ELSE 0 END
  + CASE WHEN contains(q, column_name) THEN 60 ELSE 0 END + CASE WHEN contains(q, replace(column_name, '_', ' ')) THEN 50 ELSE 0 END AS BIGINT) AS score FROM q, c"""


def compact_guard(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", sqlfeat.over_compaction(F.col("n_chars") % 700, F.col("n_chars"), F.col("doc_id") % 6).alias("why"))


def _ids():
    return F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.length(w).cast("int"))


def label_mask(spark, sf_dir):
    """Labels of rows whose first third is prompt."""
    d = _docs(spark, sf_dir).select("doc_id", _ids().alias("ids"))
    labels = pack.label_mask(F.col("ids"), F.floor(F.size("ids") / 3).cast("int"), 4096)
    return d.select("doc_id", F.array_join(F.transform(labels, lambda x: x.cast("string")), " ").alias("labels"))


_MASK_SQL = """WITH d AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w)) AS ids FROM documents), k AS (SELECT doc_id, list_slice(ids, 1, 4096) AS x, least(len(ids) // 3, 4096) AS p FROM d)
SELECT doc_id, array_to_string(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i <= p THEN '-100' ELSE CAST(x[i] AS VARCHAR) END), ' ') AS labels FROM k"""


def packed(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", (F.col("doc_id") % 8).alias("shard"), _ids().alias("ids"))
    return pack.pack(d, "shard", "doc_id", "ids", 4096, 2, whole=True)


def padded(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", _ids().alias("ids"))
    return d.select("doc_id", F.array_join(F.transform(pack.pad(F.col("ids"), F.lit(512), 0), lambda x: x.cast("string")), " ").alias("ids"))


def chat_rows(spark, sf_dir):
    """Chats written as JSON lines and read back with a schema."""
    return jsonl.round_trip(spark, chats(spark, sf_dir), "conv_id long, messages array<struct<turn:long,role:string,content:string>>").select("conv_id", F.size("messages").cast("long").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws("/", m.role, m.content)), "|").cast("binary")).alias("fp"))


QUERIES = {
    "dedup_exact": (dedup_exact, "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(lower(trim(coalesce(text, '')))) ORDER BY doc_id) AS k FROM documents) WHERE k = 1"),
    "dedup_ws": (dedup_ws, f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5({_FOLDED}) ORDER BY doc_id) AS k FROM documents) WHERE k = 1"),
    "dedup_history": (dedup_history, f"WITH d AS (SELECT doc_id, lang, md5({_FOLDED}) AS fp FROM documents), h AS (SELECT DISTINCT fp FROM d WHERE lang = 'en'), b AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS k FROM d WHERE lang <> 'en') SELECT doc_id, CASE WHEN h.fp IS NOT NULL THEN 'history' WHEN k > 1 THEN 'batch' END AS reject_reason FROM b LEFT JOIN h USING (fp)"),
    "first_seen": (first_seen, f"WITH t AS (SELECT doc_id, source, md5({_FOLDED}) AS c, 0 AS rank FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, source, md5({_FOLDED}), 1 FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY rank, doc_id) AS k FROM t) SELECT doc_id, source, CAST(rank AS BIGINT) AS rank FROM r WHERE k = 1"),
    "dedup_counters": (dedup_counters, f"WITH d AS (SELECT doc_id, lang, md5({_FOLDED}) AS fp FROM documents), h AS (SELECT DISTINCT fp FROM d WHERE lang = 'en'), b AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS k FROM d WHERE lang <> 'en'), r AS (SELECT CASE WHEN h.fp IS NOT NULL THEN 'history' WHEN k > 1 THEN 'batch' END AS x FROM b LEFT JOIN h USING (fp)) SELECT {_N} AS seen, CAST(count(*) FILTER (x = 'history') AS BIGINT) AS history, CAST(count(*) FILTER (x = 'batch') AS BIGINT) AS batch, CAST(count(*) FILTER (x IS NULL) AS BIGINT) AS kept FROM r"),
    "jaccard_pairs": (jaccard_pairs, "WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2)) AS t FROM benchmark) SELECT a.item_id, CASE WHEN len(a.t) = 0 OR len(c.t) = 0 THEN 0.0::DOUBLE ELSE CAST(len(list_intersect(a.t, c.t)) AS DOUBLE) / len(list_distinct(list_concat(a.t, c.t))) END AS overlap FROM b a JOIN b c ON c.item_id = a.item_id + 1"),
    "overlap_benchmark": (overlap_benchmark, _OVERLAP_SQL),
    "contamination_route": (contamination_route, f"WITH {_ROUTE} SELECT * FROM p"),
    "routing_counts": (routing_counts, f"WITH {_ROUTE} SELECT pool, reason, {_N} AS n FROM p GROUP BY pool, reason"),
    "cross_pool_leak": (cross_pool_leak, None),
    "edited_pool_leak": (edited_pool_leak, None),
    "neardup_greedy": (neardup_greedy, None),
    "stratified_split": (stratified_split, f"WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY {_H}, doc_id) AS k, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) SELECT doc_id, CASE WHEN n > 1 AND k <= greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) THEN 'dev' ELSE 'train' END AS split FROM r"),
    "quota_shortfall": (quota_shortfall, f"WITH q(lang, quota) AS (VALUES ('en', 700), ('fr', 150), ('de', 500), ('xx', 10)), h AS (SELECT lang, {_N} AS have FROM documents GROUP BY lang) SELECT q.lang, CAST(quota AS BIGINT) AS quota, coalesce(have, 0) AS have, greatest(0, quota - coalesce(have, 0)) AS missing FROM q LEFT JOIN h USING (lang)"),
    "roundrobin_subset": (roundrobin_subset, f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_H}, doc_id) AS k FROM documents) SELECT doc_id, source FROM r ORDER BY k > 2, CASE WHEN k > 2 THEN k ELSE 0 END, sha256(concat_ws('|', '42', source)), k, doc_id LIMIT 70"),
    "hash_rebalance": (hash_rebalance, f"WITH r AS (SELECT doc_id, {_H} AS h, row_number() OVER (PARTITION BY source ORDER BY {_H}, doc_id) AS k FROM documents) SELECT doc_id, CASE WHEN k <= 20 THEN 'test' WHEN CAST(('0x' || substr(h, 1, 8)) AS BIGINT) / 4294967295.0::DOUBLE < 0.814::DOUBLE THEN 'train' ELSE 'dev' END AS split FROM r"),
    "hash_modes": (hash_modes, f"SELECT doc_id, CASE WHEN CAST(('0x' || substr({_H}, 1, 8)) AS BIGINT) % 100 < 55 THEN 'compact' ELSE 'full' END AS mode FROM documents"),
    "exact_cut": (exact_cut, f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_H}, doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k <= floor(n * 0.9::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.95::DOUBLE) THEN 'dev' ELSE 'test' END AS split, k > n - least(800, floor(n * 0.06::DOUBLE)) AS capped_dev FROM r"),
    "upsample_plan": (upsample_plan, f"WITH {SQLS}, s AS (SELECT {_N} AS total, CAST(count(*) FILTER (regexp_matches(sql, '(?i)\\bWITH\\s+\\w+\\s+AS\\s*\\(')) AS BIGINT) AS have FROM sqls) SELECT total, have, greatest(0, CAST(floor((0.25::DOUBLE * total - have) / 0.75::DOUBLE) AS BIGINT)) AS extra FROM s"),
    "upsampled": (upsampled, f"WITH {SQLS}, f AS (SELECT doc_id, regexp_matches(sql, '(?i)\\bWITH\\s+\\w+\\s+AS\\s*\\(') AS cte FROM sqls), s AS (SELECT count(*) FILTER (cte) AS have, greatest(0, CAST(floor((0.25::DOUBLE * count(*) - count(*) FILTER (cte)) / 0.75::DOUBLE) AS BIGINT)) AS extra FROM f), r AS (SELECT doc_id, cte, row_number() OVER (PARTITION BY cte ORDER BY sha256(concat_ws('|', '0', CAST(doc_id AS VARCHAR))), doc_id) AS k FROM f) SELECT doc_id, CAST(1 + CASE WHEN cte THEN extra // have + CASE WHEN k <= extra % have THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS times FROM r, s"),
    "undersample": (undersample, f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_H}, doc_id) AS k FROM documents) WHERE k <= 100"),
    "capped_accept": (capped_accept, "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 90 // (SELECT count(DISTINCT source) FROM documents)"),
    "sampling_weight": (sampling_weight, f"WITH r AS ({_ROUTED_SQL}) SELECT doc_id, floor((CASE kind WHEN 'real_failure' THEN 1.3::DOUBLE WHEN 'contrastive' THEN 1.2::DOUBLE WHEN 'manual_fix' THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN doc_id % 2 = 0 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN bench THEN 1.15::DOUBLE WHEN doc_id % 2 = 1 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS weight FROM r"),
    "largest_remainder": (largest_remainder, f"WITH t AS (SELECT source, {_N} AS total FROM documents GROUP BY source), p(part, w, pos) AS (VALUES ('train', 80, 0), ('dev', 10, 1), ('test', 10, 2)), x AS (SELECT source, part, pos, total, total * w::DOUBLE / 100.0::DOUBLE AS e FROM t, p), y AS (SELECT *, CAST(floor(e) AS BIGINT) AS base FROM x), z AS (SELECT *, total - sum(base) OVER (PARTITION BY source) AS rest, row_number() OVER (PARTITION BY source ORDER BY e - base DESC, pos) AS k FROM y) SELECT source, part, CAST(base + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM z"),
    "deficit": (deficit, f"WITH t AS (SELECT source, {_N} AS have FROM documents GROUP BY source) SELECT source, greatest(0, 52 - have) AS missing FROM t ORDER BY missing DESC, source LIMIT 10"),
    "alignment_antijoin": (alignment, _USED + " SELECT doc_id, name FROM u WHERE NOT regexp_matches(name, '^t[0-9]+$') AND name NOT IN ('subquery', 'sub', 'temp', 'orders', 'part') AND name NOT IN (SELECT 'src' || CAST(2 * k AS VARCHAR) FROM range(0, 10) AS r(k))"),
    "fk_paths": (fk_paths, _PATHS_SQL),
    "nhop": (nhop, f"WITH {_EDGES}, h AS (SELECT 'supplier' AS t, 0 AS d UNION ALL SELECT b, 1 FROM e WHERE a = 'supplier' UNION ALL SELECT y.b, 2 FROM e x JOIN e y ON x.b = y.a WHERE x.a = 'supplier') SELECT t AS table_name, CAST(min(d) AS BIGINT) AS distance FROM h GROUP BY t"),
    "bridge_tables": (bridge_tables, f"WITH {_EDGES}, s(t) AS (VALUES ('customer'), ('supplier'), ('orders'), ('part')) SELECT b AS table_name, CAST(count(DISTINCT a) AS BIGINT) AS links FROM e WHERE a IN (SELECT t FROM s) AND b NOT IN (SELECT t FROM s) GROUP BY b HAVING count(DISTINCT a) >= 2"),
    "column_score": (column_score, _SCORE_SQL),
    "compact_guard": (compact_guard, "SELECT doc_id, CASE WHEN n_chars > 2000 AND n_chars % 700 < 400 THEN 'too small' WHEN n_chars > 3000 AND 100 * (1 - CAST(n_chars % 700 AS DOUBLE) / n_chars) > 85 THEN 'too aggressive' WHEN doc_id % 6 < 3 THEN 'too thin' END AS why FROM documents"),
    "label_mask": (label_mask, _MASK_SQL),
    "pad": (padded, "WITH d AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w)) AS ids FROM documents) SELECT doc_id, array_to_string(list_transform(range(1, greatest(len(ids), 512) + 1), lambda i: CAST(coalesce(ids[i], 0) AS VARCHAR)), ' ') AS ids FROM d"),
    "pack": (packed, None),
    "jsonl_round_trip": (chat_rows, "SELECT conv_id, CAST(count(*) AS BIGINT) AS n, md5(string_agg(concat_ws('/', role, text), '|' ORDER BY turn)) AS fp FROM conversations GROUP BY conv_id"),
}
