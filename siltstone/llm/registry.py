"""The queries p5 to p9 and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.words import stripped, word32
from siltstone.llm.mixing import Target, mix, mix_shares, mix_violations
from siltstone.llm.packing import pack_tokens, pack_violations
from siltstone.llm.spans import shared_share, shared_span_classes, shared_span_pairs
from siltstone.llm.survivors import DATE, Field, latest_by_currency, sources_of
from siltstone.llm.tokens import token_counts
from siltstone.llm.topn import top_n
from siltstone.session import materialize
from siltstone.sources.tables import table

SITE = ["binary_stem", "site_address"]
SUPPLIED = ["proposed_label", "confidence", "triage_rank", "related_chain_ids"]


def _review_rows(spark: SparkSession, d: str) -> DataFrame:
    """supervision_queue with the site as a number and the trust of its origin."""
    trust = table(spark, d, "origin_trust").groupBy(F.lower(stripped(F.col("origin"))).alias("_origin")).agg(F.max("trust").alias("_trust"))
    rows = table(spark, d, "supervision_queue").withColumn("_origin", F.lower(stripped(F.col("origin")))).join(trust, "_origin", "left")
    return rows.withColumn("site_address", word32(F.col("site"))).withColumn("_trust", F.coalesce("_trust", F.lit(0)))


def _fields() -> list[Field]:
    label, trust = stripped(F.col("proposed_label")), F.col("_trust")
    chains = F.array_sort(F.array_distinct(F.filter("related_chain_ids", lambda x: stripped(x) != "")))
    return [
        Field("proposed_label", F.col("proposed_label"), (label != "") & (F.upper(label) != "UNKNOWN"), [trust, DATE]),
        Field("confidence", F.col("confidence"), F.col("confidence").between(0.0, 1.0), [trust, DATE], F.col("confidence")),
        Field("triage_rank", F.col("triage_rank"), F.col("triage_rank").between(1, 999998), [DATE, trust], F.col("triage_rank")),
        Field("related_chain_ids", chains, F.size(chains) > 0, [F.size(chains), DATE]),
    ]


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    return latest_by_currency(_review_rows(spark, d), SITE, "row_id", _fields(), "updated_at", undated="earliest")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Which review row supplies each field of a site's merged record."""
    return sources_of(_survivors(spark, d), SITE, SUPPLIED)


def p5_merged(spark: SparkSession, d: str) -> DataFrame:
    """The merged record of every site."""
    values = [F.col(f"{n}.value").alias(n) for n in SUPPLIED[:2]] + [F.col("triage_rank.value").cast("double").alias("triage_rank"), F.coalesce(F.size("related_chain_ids.value"), F.lit(0)).alias("n_chains")]
    return _survivors(spark, d).select(*SITE, *values)


def p5_currency(spark: SparkSession, d: str) -> DataFrame:
    """The topologically latest value of every field of a site, as text, undated rows placed by learned precedence."""
    label = stripped(F.col("proposed_label"))
    fields = [
        Field("proposed_label", label, (label != "") & (F.upper(label) != "UNKNOWN"), [DATE, F.col("_trust")]),
        Field("confidence", F.col("confidence"), F.col("confidence").between(0.0, 1.0), [DATE, F.col("_trust")], F.col("confidence")),
        Field("triage_rank", F.col("triage_rank"), F.col("triage_rank").between(1, 999998), [DATE, F.col("_trust")], F.col("triage_rank")),
        Field("related_chain_ids", _fields()[3].value, _fields()[3].usable, [DATE, F.col("_trust")], F.size(_fields()[3].value)),
    ]
    best = latest_by_currency(_review_rows(spark, d), SITE, "row_id", fields, "updated_at")
    written = {"related_chain_ids": lambda c: F.array_join(c, ","), "confidence": lambda c: F.format_string("%.6f", c)}
    text = lambda n: F.when(F.col(n).isNotNull(), written.get(n, lambda c: c.cast("string"))(F.col(f"{n}.value")))
    each = F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(f"{n}.row_id").alias("row_id"), text(n).alias("value"), F.col(f"{n}.basis").alias("basis")) for n in SUPPLIED])
    return best.select(*SITE, F.explode(each).alias("e")).select(*SITE, "e.*").filter("row_id IS NOT NULL")


P5_ROWS = r"""
trust AS (SELECT lower(trim(origin)) o, max(trust) t FROM origin_trust GROUP BY 1),
q AS (
  SELECT s.*, CAST(concat('0x', substr(lower(trim(site)), 3)) AS BIGINT) site_address, coalesce(t, 0) tr, coalesce(updated_at, TIMESTAMP '0001-01-01') ts,
    len(list_distinct([x FOR x IN coalesce(related_chain_ids, CAST([] AS VARCHAR[])) IF x IS NOT NULL AND trim(x) <> ''])) nc
  FROM supervision_queue s LEFT JOIN trust ON lower(trim(s.origin)) = o WHERE binary_stem IS NOT NULL AND site IS NOT NULL
), g AS (SELECT binary_stem, site_address FROM q GROUP BY ALL HAVING count(DISTINCT row_id) > 1),
r AS (
  SELECT q.*,
    proposed_label IS NOT NULL AND trim(proposed_label) <> '' AND upper(trim(proposed_label)) <> 'UNKNOWN' ul, confidence IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 uc, coalesce(triage_rank BETWEEN 1 AND 999998, false) ur
  FROM q JOIN g USING (binary_stem, site_address)
)"""
P5_SQL = f"""
WITH {P5_ROWS}
SELECT binary_stem, site_address, 'proposed_label' field_name, row_id FROM (SELECT *, row_number() OVER (PARTITION BY binary_stem, site_address ORDER BY tr DESC, ts DESC, row_id) n FROM r WHERE ul) WHERE n = 1
UNION ALL SELECT binary_stem, site_address, 'confidence', row_id FROM (SELECT *, row_number() OVER (PARTITION BY binary_stem, site_address ORDER BY tr DESC, ts DESC, row_id) n FROM r WHERE uc) WHERE n = 1
UNION ALL SELECT binary_stem, site_address, 'triage_rank', row_id FROM (SELECT *, row_number() OVER (PARTITION BY binary_stem, site_address ORDER BY ts DESC, tr DESC, row_id) n FROM r WHERE ur) WHERE n = 1
UNION ALL SELECT binary_stem, site_address, 'related_chain_ids', row_id FROM (SELECT *, row_number() OVER (PARTITION BY binary_stem, site_address ORDER BY nc DESC, ts DESC, row_id) n FROM r WHERE nc > 0) WHERE n = 1"""


P5_CURRENCY_SQL = f"""
WITH RECURSIVE {P5_ROWS.replace("ts,", "ts, list_sort(list_distinct([x FOR x IN coalesce(related_chain_ids, CAST([] AS VARCHAR[])) IF x IS NOT NULL AND trim(x) <> ''])) ch,", 1)},
long AS (
  SELECT binary_stem, site_address, row_id, updated_at t, tr, 'proposed_label' f, trim(proposed_label) v, CAST(NULL AS DOUBLE) k FROM r WHERE ul
  UNION ALL SELECT binary_stem, site_address, row_id, updated_at, tr, 'confidence', printf('%.6f', confidence), confidence FROM r WHERE uc
  UNION ALL SELECT binary_stem, site_address, row_id, updated_at, tr, 'triage_rank', CAST(triage_rank AS VARCHAR), triage_rank FROM r WHERE ur
  UNION ALL SELECT binary_stem, site_address, row_id, updated_at, tr, 'related_chain_ids', array_to_string(ch, ','), nc FROM r WHERE nc > 0
), vals AS (SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY binary_stem, site_address, f, v ORDER BY t DESC NULLS LAST, tr DESC, row_id) = 1),
cand AS (SELECT * FROM (SELECT *, max(t) OVER (PARTITION BY binary_stem, site_address, f) mt FROM vals) WHERE t IS NULL OR t = mt),
steps AS (SELECT * FROM (SELECT f, v b, k kb, lag(v) OVER w a, lag(k) OVER w ka FROM vals WHERE t IS NOT NULL WINDOW w AS (PARTITION BY binary_stem, site_address, f ORDER BY t, v)) WHERE a IS NOT NULL),
cnt AS (SELECT a, b, count(*) n FROM steps WHERE f = 'proposed_label' GROUP BY ALL),
net AS (SELECT cnt.a, cnt.b FROM cnt LEFT JOIN cnt o ON o.a = cnt.b AND o.b = cnt.a WHERE cnt.n > coalesce(o.n, 0)),
reach AS (SELECT a, b FROM net UNION SELECT reach.a, net.b FROM reach JOIN net ON reach.b = net.a),
strict AS (SELECT a, b FROM reach WHERE NOT EXISTS (SELECT 1 FROM reach o WHERE o.a = reach.b AND o.b = reach.a)),
rise AS (SELECT f, sign(sum(sign(kb - ka))) s FROM steps WHERE f <> 'proposed_label' GROUP BY 1),
judged AS (
  SELECT c.*, CASE WHEN c.f = 'proposed_label' THEN EXISTS (SELECT 1 FROM cand o JOIN strict ON strict.b = o.v WHERE strict.a = c.v AND o.f = c.f AND o.binary_stem = c.binary_stem AND o.site_address = c.site_address)
    ELSE coalesce(rise.s * c.k < max(rise.s * c.k) OVER (PARTITION BY c.binary_stem, c.site_address, c.f), false) END beaten
  FROM cand c LEFT JOIN rise ON rise.f = c.f)
SELECT binary_stem, site_address, f field_name, row_id, v "value", CASE WHEN mt IS NULL THEN 'undated' WHEN t IS NOT NULL THEN 'dated' ELSE 'learned' END basis
FROM judged QUALIFY row_number() OVER (PARTITION BY binary_stem, site_address, f ORDER BY beaten, t IS NULL, tr DESC, row_id) = 1"""


P5_MERGED_SQL = f"""
WITH f AS ({P5_SQL}), s AS (SELECT DISTINCT binary_stem, CAST(concat('0x', substr(lower(trim(site)), 3)) AS BIGINT) site_address, row_id FROM supervision_queue WHERE binary_stem IS NOT NULL AND site IS NOT NULL),
g AS (SELECT binary_stem, site_address FROM s GROUP BY ALL HAVING count(*) > 1)
SELECT g.binary_stem, g.site_address, max(CASE WHEN field_name = 'proposed_label' THEN q.proposed_label END) proposed_label, max(CASE WHEN field_name = 'confidence' THEN q.confidence END) confidence, CAST(max(CASE WHEN field_name = 'triage_rank' THEN q.triage_rank END) AS DOUBLE) triage_rank,
  CAST(coalesce(max(CASE WHEN field_name = 'related_chain_ids' THEN len(list_distinct([x FOR x IN q.related_chain_ids IF x IS NOT NULL AND trim(x) <> ''])) END), 0) AS INT) n_chains
FROM g LEFT JOIN f ON g.binary_stem = f.binary_stem AND g.site_address = f.site_address LEFT JOIN supervision_queue q ON q.row_id = f.row_id GROUP BY ALL"""


def _chain_values(spark: SparkSession, d: str) -> DataFrame:
    """Every chain of a sink with the best priority it was ever queued with."""
    queued = table(spark, d, "triage_queue").select("chain_id", "triage_priority").filter("triage_priority IS NOT NULL AND NOT isnan(triage_priority)")
    best = queued.groupBy("chain_id").agg(F.max("triage_priority").alias("value"))
    chains = table(spark, d, "chains").select("binary_stem", F.col("sink.sink_id").alias("sink_id"), "chain_id").filter("sink_id IS NOT NULL").distinct()
    return chains.join(best, "chain_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The three best chains of every sink."""
    return top_n(_chain_values(spark, d), ["binary_stem", "sink_id"], "chain_id", "value", 3).select("binary_stem", "sink_id", "chain_id", "place")


P6_SQL = """
WITH v AS (SELECT chain_id, max(triage_priority) value FROM triage_queue WHERE triage_priority IS NOT NULL AND NOT isnan(triage_priority) GROUP BY 1),
c AS (SELECT DISTINCT binary_stem, sink.sink_id sink_id, chain_id FROM chains WHERE sink.sink_id IS NOT NULL AND binary_stem IS NOT NULL)
SELECT binary_stem, sink_id, chain_id, CAST(place AS INTEGER) place FROM (
  SELECT c.*, row_number() OVER (PARTITION BY binary_stem, sink_id ORDER BY value DESC, chain_id) place FROM c JOIN v USING (chain_id)) WHERE place <= 3"""


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    """The container kinds, a parameter table of a few rows."""
    return {r[0]: r[1] for r in table(spark, d, "pack_capacities").select("container", "capacity_tokens").dropna().collect()}


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or piece of one, for each container kind."""
    return pack_tokens(token_counts(table(spark, d, "documents"), ["doc_id"]), _capacities(spark, d))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How well each kind of container is filled: containers, the least number possible, tokens."""
    ids = p7_pack(spark, d).groupBy("container", "capacity", "container_id").agg(F.sum("piece_size").alias("n"))
    return ids.groupBy("container", "capacity").agg(F.count("*").alias("containers"), F.ceil(F.sum("n") / F.col("capacity")).alias("least"), F.sum("n").alias("tokens"))


def p7_violations(spark: SparkSession, d: str) -> DataFrame:
    """What the packing does wrong: no row, if every text has its place, none is cut without need and no container is overfull."""
    counted = materialize(token_counts(table(spark, d, "documents"), ["doc_id"]), "counted")
    capacities = _capacities(spark, d)
    return pack_violations(materialize(pack_tokens(counted, capacities), "packed"), counted, capacities)


def _targets(spark: SparkSession, d: str) -> list[Target]:
    """The target shares, a parameter table of a few rows."""
    return [Target(*r) for r in table(spark, d, "mix_targets").select("source", "target_share", "max_repeats").dropna().collect()]


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix, slot by slot: which part of which document stands where."""
    docs = table(spark, d, "documents").withColumn("source", F.lower(stripped(F.col("source"))))
    counted = token_counts(docs, ["doc_id", "source"])
    return mix(counted, "source", "doc_id", "n_tokens", _targets(spark, d))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares the mix reached beside those it should have."""
    return mix_shares(materialize(p8_mix(spark, d), "mix"), _targets(spark, d))


def p8_violations(spark: SparkSession, d: str) -> DataFrame:
    """What the mix does wrong: no row, if caps, slots, blocks and items are kept to."""
    counted = materialize(token_counts(table(spark, d, "documents"), ["doc_id"]), "counted")
    return mix_violations(materialize(p8_mix(spark, d), "mix"), counted, _targets(spark, d), "doc_id", "n_tokens")


#: Nothing may be found.
P7_VIOLATIONS_SQL = "SELECT container, CAST(NULL AS VARCHAR) id, CAST(NULL AS VARCHAR) problem FROM pack_capacities WHERE false"
P8_VIOLATIONS_SQL = "SELECT source, CAST(NULL AS VARCHAR) problem FROM mix_targets WHERE false"


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share 200 or more consecutive code points."""
    return shared_span_pairs(table(spark, d, "documents"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """For every document how many of its code points stand in another document too, within long spans."""
    return shared_share(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document long enough to share a span: its class of exact copies and how many other classes it shares one with."""
    return shared_span_classes(table(spark, d, "documents"))


P9_SQL = """
WITH w AS (SELECT doc_id, i, md5(substr(text, i, 200)) h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) i FROM documents WHERE length(text) >= 200)),
r AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), d AS (SELECT DISTINCT doc_id, h FROM w WHERE h IN (SELECT h FROM r))
SELECT DISTINCT a.doc_id doc_id_a, b.doc_id doc_id_b FROM d a JOIN d b ON a.h = b.h AND a.doc_id < b.doc_id"""
P9_SHARED_SQL = """
WITH w AS (SELECT doc_id, i, md5(substr(text, i, 200)) h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) i FROM documents WHERE length(text) >= 200)),
r AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, sum(least(200, coalesce(nxt - i, 200))) n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) nxt FROM w WHERE h IN (SELECT h FROM r)) GROUP BY 1),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) class_id FROM documents WHERE length(text) >= 200)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) class_id, CAST(length(text) AS INTEGER) n_chars, CAST(coalesce(c.n, 0) AS BIGINT) shared_chars FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id WHERE text IS NOT NULL"""


P9_CLASSES_SQL = f"""
WITH p AS ({P9_SQL}), k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) class_id, count(*) OVER (PARTITION BY md5(text)) copies FROM documents WHERE length(text) >= 200),
l AS (SELECT x.class_id a, y.class_id b FROM p JOIN k x ON x.doc_id = doc_id_a JOIN k y ON y.doc_id = doc_id_b WHERE x.class_id <> y.class_id),
n AS (SELECT a, count(DISTINCT b) links FROM (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) GROUP BY 1)
SELECT doc_id, class_id, copies, coalesce(links, 0) links FROM k LEFT JOIN n ON n.a = k.class_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p5_found, p5_merged, p5_currency, p6_found, p7_pack, p7_fill, p7_violations, p8_mix, p8_shares, p8_violations, p9_found, p9_shared, p9_classes)}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_SQL, "p5_merged": P5_MERGED_SQL, "p5_currency": P5_CURRENCY_SQL, "p6_found": P6_SQL, "p7_violations": P7_VIOLATIONS_SQL, "p8_violations": P8_VIOLATIONS_SQL, "p9_found": P9_SQL, "p9_shared": P9_SHARED_SQL, "p9_classes": P9_CLASSES_SQL}
