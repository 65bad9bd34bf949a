"""One registered query per operator, on its whole table, next to equivalent SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqrec.llm import decontaminate, infill, langid, licences, lines, minhash, mixing, pii, shards, simhash, spelling, topk, warc
from seqrec.llm.common import table
from seqrec.session import cut_lineage, ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from two thirds of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = langid.learnable(docs)
    profiles = langid.fit(docs.filter(learn))
    found = langid.identify(docs.select("doc_id", "text"), profiles)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


@query()
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [F.size(F.filter("spans", _of_kind(kind))).cast("long").alias(f"n_{kind}")
              for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


# Source and language weights of the mixing query, by node name; domains are thirds of the sources.
DOMAIN_WEIGHTS = {"=d0": 5, "=d1": 3, "=d2": 2}
LANGUAGE_WEIGHTS = {"=en": 4, "=de": 2, "=fr": 2, "=es": 3}
SOURCE_WEIGHTS = {"=src0": 3, "=src1": 2}


def weight(level: int, weights: dict[str, int]):
    """The weight of a node by its name, 1 where none is given."""
    chosen = F.lit(1)
    for name, value in weights.items():
        chosen = F.when(F.col(f"level_{level}") == name, F.lit(value)).otherwise(chosen)
    return chosen


def domain():
    """The domain of a document: the number of its source modulo 3."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (F.expr(f"try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT)") % 3).cast("string")))


def _cases(level: int, weights: dict[str, int]) -> str:
    return f"CASE level_{level} " + " ".join(f"WHEN '{n}' THEN {v}" for n, v in weights.items()) + " ELSE 1 END"


def _fill_sql(name: str, nodes: str, family: str, own: str) -> str:
    """Water filling of ``given`` among the rows of ``nodes`` with one ``family``."""
    over = f"PARTITION BY {family}" if family else ""
    order = f"{over} ORDER BY cap / nullif(w, 0) NULLS LAST, {own}"
    return f"""
{name}_a AS (SELECT *, CASE WHEN cap > 0 THEN weight ELSE 0 END AS w FROM {nodes}),
{name}_b AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(w) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before,
    sum(w) OVER ({over}) AS weights FROM {name}_a),
{name}_c AS (SELECT *, CAST(cap AS HUGEINT) * (weights - weight_before) <= CAST(w AS HUGEINT) * greatest(given - cap_before, 0) AS f FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN f THEN 0 ELSE w END AS ow,
    given - sum(CASE WHEN f THEN cap ELSE 0 END) OVER ({over}) AS remaining FROM {name}_c),
{name}_e AS (SELECT *, CAST(sum(ow) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS HUGEINT) AS upto,
    CAST(sum(ow) OVER ({over}) AS HUGEINT) AS oall FROM {name}_d),
{name} AS (SELECT *, CASE WHEN f THEN cap ELSE least(coalesce(upto * remaining // nullif(oall, 0) - (upto - ow) * remaining // nullif(oall, 0), 0), cap) END AS budget FROM {name}_e)"""


MIX_FRACTION, MIX_EPOCHS = (2, 3), 3


def mix_sql(fraction: tuple[int, int], max_epochs: int, documents: str = "documents") -> str:
    """The tables ``mixed`` (doc_id, copies, tokens, leaf) by ordinary windows."""
    return f"""
sizes AS (SELECT *, coalesce('=' || domain, '-') AS level_0, coalesce('=' || lang, '-') AS level_1,
    coalesce('=' || source, '-') AS level_2,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS tokens
  FROM (SELECT *, 'd' || CAST(CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 3 AS VARCHAR) AS domain FROM {documents})),
leaves AS (SELECT level_0, level_1, level_2, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n_rows FROM sizes GROUP BY ALL),
weighed AS (SELECT *, tokens * {max_epochs} AS cap, {_cases(0, DOMAIN_WEIGHTS)} AS w0, {_cases(1, LANGUAGE_WEIGHTS)} AS w1,
    {_cases(2, SOURCE_WEIGHTS)} AS w2 FROM leaves),
top AS (SELECT least(sum(cap), sum(tokens) * {fraction[0]} // {fraction[1]}) AS given FROM weighed),
n0 AS (SELECT level_0, sum(cap) AS cap, max(w0) AS weight, (SELECT given FROM top) AS given FROM weighed GROUP BY level_0),
{_fill_sql('b0', 'n0', '', 'level_0')},
n1 AS (SELECT x.level_0, x.level_1, sum(x.cap) AS cap, max(w1) AS weight, max(b0.budget) AS given
  FROM weighed x JOIN b0 USING (level_0) GROUP BY x.level_0, x.level_1),
{_fill_sql('b1', 'n1', 'level_0', 'level_1')},
n2 AS (SELECT x.level_0, x.level_1, x.level_2, sum(x.cap) AS cap, max(w2) AS weight, max(b1.budget) AS given
  FROM weighed x JOIN b1 USING (level_0, level_1) GROUP BY x.level_0, x.level_1, x.level_2),
{_fill_sql('b2', 'n2', 'level_0, level_1', 'level_2')},
plan AS (SELECT l.*, CAST(b2.budget AS BIGINT) AS budget, CAST(coalesce(b2.budget // nullif(l.tokens, 0), 0) AS BIGINT) AS epochs
  FROM leaves l JOIN b2 USING (level_0, level_1, level_2)),
keyed AS (SELECT s.*, epochs, budget - epochs * p.tokens AS leaf_rest,
    md5('{mixing.SEED}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mix_key
  FROM sizes s JOIN plan p USING (level_0, level_1, level_2)),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY level_0, level_1, level_2 ORDER BY mix_key) AS upto FROM keyed),
mixed AS (SELECT *, CAST(epochs + CASE WHEN leaf_rest > 0 AND upto <= leaf_rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM run)"""


@query(f"""WITH {mix_sql(MIX_FRACTION, MIX_EPOCHS)}
SELECT doc_id, domain, lang, source, tokens, copies FROM mixed WHERE copies > 0""")
def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the mixture takes, and how often."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", domain().alias("domain"), "lang", "source")
    mixed = mixing.mix(docs, [F.col("domain"), F.col("lang"), F.col("source")],
                       [weight(0, DOMAIN_WEIGHTS), weight(1, LANGUAGE_WEIGHTS), weight(2, SOURCE_WEIGHTS)],
                       fraction=MIX_FRACTION, max_epochs=MIX_EPOCHS)
    return mixed.select("doc_id", "domain", "lang", "source", mixing.tokens_of(F.col("text")).alias("tokens"), "copies")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query(f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
numbered AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{_UPPER}', '{_UPPER.lower()}') AS key FROM numbered),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {lines.MIN_LENGTH} GROUP BY key
  HAVING count(DISTINCT doc_id) >= {lines.MIN_DOCS}),
marked AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts of lines and the digest of what stays."""
    kept = lines.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {warc.MIN_REVISIT} AND first_id <> page_id THEN first_id END AS refers_to FROM f""")
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it comes back from the archives it was written to."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    # the captures are read twice: for themselves and for what others refer to
    found = warc.resolved(cut_lineage(warc.captures(warc.read_records(spark, path, keep_payload=False))))
    page = lambda of: F.try_element_at(f"{of}.fields", F.lit("pageid")).cast("long")
    return found.select(
        page("metadata").alias("page_id"), F.coalesce("capture.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.type").alias("record_type"),
        page("original.metadata").alias("refers_to"))


_CRC_TABLE = ("(SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])), "
              "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) "
              "FROM range(256) t(i))")


@query(f"""WITH crc_table AS (SELECT {_CRC_TABLE} AS t),
bytes AS (SELECT doc_id, source, coalesce(text, '') AS body FROM documents),
sized AS (SELECT doc_id, source, CAST(strlen(body) + 16 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(body)), '..'),
        lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes, crc_table),
keyed AS (SELECT *, md5('{shards.SEED}:' || doc_id) AS key FROM sized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id) AS r,
    count(*) OVER (PARTITION BY source) AS total FROM keyed),
mixed AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * r - 1 AS DOUBLE) / CAST(2 * total AS DOUBLE), source NULLS FIRST, key, doc_id) - 1 AS p,
    count(*) OVER () AS n FROM ranked),
cut AS (SELECT *, p * {shards.SHARDS} // n AS s FROM mixed)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(s AS INTEGER) AS shard,
  CAST(p - (s * n + {shards.SHARDS - 1}) // {shards.SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut""")
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place there, row counts equal to one."""
    text = F.col("text")
    keys = table(spark, sf_dir, "documents").select(
        "doc_id", "source", shards.size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    placed = shards.interleave(keys)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


QUERY_EVERY, TOP = 20, 20


@query(f"""WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % {QUERY_EVERY} = 0 AND q.vec_id <> x.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {TOP}""")
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors.filter(F.col("vec_id") % QUERY_EVERY == 0), vectors, TOP)


@query()
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and the edits between them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.tagged(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.edits", "m.end_word", "m.n_words")


@query()
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph of every document that states a licence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan(docs, licences.fit(docs))
    return found.select("doc_id", F.explode("licences").alias("l")).select("doc_id", "l.*")


_SPACES = r"\x20\x09-\x0D"
_HAS_MARK = " OR ".join(f"contains(t, '<{m}>')" for m in "PSM")


@query(f"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+') AS l,
    sha256('{infill.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, CAST(len(l) AS BIGINT) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(d, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM u),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR {_HAS_MARK} OR h[3] % 100 >= {infill.RATE} THEN 'plain'
         WHEN h[4] % 100 < {infill.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle,
    array_to_string(l[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""")
def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut for filling in the middle, and restored again."""
    made = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infill.restored(F.col("infill.output"), F.col("infill.form"))
    return made.select("doc_id", "infill.n", "infill.form", "infill.prefix_chars", "infill.middle_chars",
                       F.sha2("infill.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


_FACTOR, _EVERY = spelling.FACTOR, spelling.SLIP_EVERY


@query(f"""WITH RECURSIVE crc_table AS MATERIALIZED (SELECT {_CRC_TABLE} AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{_UPPER}', '{_UPPER.lower()}') AS run
  FROM documents),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS body, run, count(*) AS c FROM runs
  WHERE length(run) >= {spelling.MIN_CHARS} GROUP BY ALL),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(body)), '..'),
        lambda h: CAST('0x' || h AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM counted, crc_table),
formed AS (SELECT CASE WHEN h % {_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c
  FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM formed WHERE length(word) >= {spelling.MIN_CHARS}
  GROUP BY word HAVING sum(c) >= {spelling.MIN_COUNT}),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT x.word, y.word AS other FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, x.rest FROM cut x JOIN v ON v.word = x.rest
  UNION SELECT x.rest, x.word FROM cut x JOIN v ON v.word = x.rest),
ranked AS (SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS r FROM near JOIN v o ON o.word = other),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {_FACTOR} * v.n THEN other END AS form,
    CASE WHEN other_n >= {_FACTOR} * v.n THEN other_n END AS form_n FROM v LEFT JOIN ranked ON ranked.word = v.word AND r = 1),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word
JOIN f AS last ON last.word = chain.at AND last.form IS NULL""")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every longer word of the corpus with its near words, its form and its root."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spelling.variants(spelling.word_counts(docs, slip_every=spelling.SLIP_EVERY))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query()
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component of near copies."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))
