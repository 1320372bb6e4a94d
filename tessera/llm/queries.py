"""The queries of this subpackage, and SQL for those that DuckDB can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, collocations, compression, decontam, lm_bloom, mixing, packing, periodic, pii, repetition, simhash, suffix_dedup, tokens
from tessera.llm.common import WORD, id_text, read, small_batches, text_or_empty


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.as_hex(F.col("fingerprint_bits")).alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.pareto_mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix in SQL, each source sorted as a whole. MD5 stands for the random number on both sides.
OP2_SQL = """
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':42'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM docs GROUP BY source),
weighted AS (
  SELECT *, (CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM sizes),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () -
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
    sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
goal AS (
  SELECT source, source_size,
    coalesce(least(cap, weight * (SELECT l.level FROM levels l WHERE l.level * l.weight <= l.cap ORDER BY l.cap / l.weight, l.level LIMIT 1)), cap) AS target
  FROM levels),
ranked AS (
  SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS r
  FROM docs d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
lots AS (
  SELECT *, floor(r) AS whole, CASE WHEN r > floor(r) THEN ln(u / (1 - u)) - ln((r - floor(r)) / (1 - (r - floor(r)))) END AS rank FROM ranked),
upto AS (
  SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS extra,
    sum(size) FILTER (rank IS NOT NULL) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle
  FROM lots)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN rank IS NOT NULL AND middle <= extra THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM upto
"""


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of conversations is a record of the layout "turn rows"; conversation -1 is added."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    records = rows.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    turns = chat.canonical_turns(records, "conv_id", "turn", "record")
    return chat.read_back(chat.format_turns(turns)).withColumnRenamed("id", "conv_id")


def _escaped_sql(c: str) -> str:
    c = f"replace(coalesce({c}, ''), '\\', '\\\\')"
    for s in chat.CONTROL:
        c = f"replace({c}, '{s}', '{s[0]}\\{s[1:]}')"
    return c


OP3_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.OPEN + chat.SEP + chat.CLOSE)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op4_tokens(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    import public_tokenizers

    counted = tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone count base spans; the n_added columns count what the model adds."""
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", pii.pii_spans(text_or_empty(F.col("text")), pii.train()).alias("found"))
    base = F.filter("found", lambda s: s["base"])
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return docs.select(
        "doc_id", *[count(base, k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        *[(count(F.col("found"), k) - count(base, k)).alias(f"n_added_{k}") for k in pii.KINDS],
    )


def op6_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 5, 0))
    model = compression.train(docs.where(~F.col("held_out")), read(spark, sf_dir, "labels"))
    scored = compression.score_documents(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves the given remainder; a null id is the empty text."""
    return F.pmod(F.crc32(id_text(F.col(id_col)).cast("binary")), F.lit(parts)) == part


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", repetition.repetition(F.col("text")).alias("m"))
    failed = (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    return docs.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", failed.alias("base_failed"), (~failed & repetition.repetition_rules(F.col("m"))).alias("kept"))


def _repeated_sql(k: int) -> str:
    """Starts of k-word windows that occur twice or more in their text; later: not the first such start."""
    return f"""SELECT row_no, i, {k} AS k, later FROM (
    SELECT row_no, i, count(*) OVER same AS n, i > min(i) OVER same AS later FROM (
      SELECT row_no, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k})
    WINDOW same AS (PARTITION BY row_no, hash(w[i:i + {k - 1}]), w[i], w[i + {k - 1}])) WHERE n > 1"""


#: A word is in a later occurrence of a repeat of ten or more words just if it is in a ten-word window found before; a
#: repeat is longer than 50 words just if a 51-word window is found twice.
OP7_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS ({_repeated_sql(3)} UNION ALL {_repeated_sql(10)} UNION ALL {_repeated_sql(51)}),
spans AS (
  SELECT row_no, k, i, i + k AS e, max(i + k) OVER (PARTITION BY row_no, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto
  FROM starts WHERE k <> 10 OR later),
r AS (SELECT row_no, k, sum(e - greatest(i, least(coalesce(upto, i), e))) AS n FROM spans GROUP BY row_no, k),
lines AS (
  SELECT row_no, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT row_no, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row_no),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
    coalesce((SELECT n FROM r WHERE r.row_no = d.row_no AND k = 3), 0)::BIGINT AS n_repeat_words,
    coalesce((SELECT n FROM r WHERE r.row_no = d.row_no AND k = 10), 0)::BIGINT AS n_later,
    EXISTS (SELECT 1 FROM r WHERE r.row_no = d.row_no AND k = 51) AS too_long
  FROM d LEFT JOIN lines USING (row_no))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_later <= 0.15::DOUBLE * n_words AND NOT too_long AS kept
FROM m
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontam.contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return docs.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["item_ids"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, w[i:i + 9] AS win FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
  UNION SELECT item, w FROM b WHERE len(w) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
starts AS (
  SELECT row_no, i, n, w[i:i + n - 1] AS win FROM (
    SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT row_no, i, n, item FROM starts JOIN windows USING (win)),
hits AS (SELECT row_no, count(DISTINCT p) AS n_hit FROM (SELECT row_no, unnest(range(i, i + n)) AS p FROM found) GROUP BY row_no),
owners AS (SELECT row_no, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY row_no)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row_no) LEFT JOIN owners USING (row_no)
"""

def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 7, 2))
    model, exact = lm_bloom.train(docs.where(~F.col("held_out")))
    return lm_bloom.score(docs, model, exact, keep=("held_out",))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_passages counts runs covered by repeats of over 50 words, which can be shorter than the strings that are removed."""
    docs = suffix_dedup.repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return docs.select(
        "doc_id", F.octet_length(text_or_empty(F.col("text"))).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2(suffix_dedup.kept_bytes(F.col("text"), F.col("spans")), 256).alias("kept_sha256"), F.size("passages").cast("long").alias("n_passages"),
    )


def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_suffix_dedup without its column of passages, which SQL does not express."""
    return op10_suffix_dedup(spark, sf_dir).drop("n_passages")


#: 400-byte strings by their hashes, on texts as hex digits.
REPEATED_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, i, hash(h[2 * i + 1 : 2 * i + 800]) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d WHERE len(h) >= 800)),
hit AS (SELECT r, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, i > 400 + max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fresh FROM hit),
runs AS (SELECT r, i, sum(CASE WHEN coalesce(fresh, true) THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS n FROM g),
spans AS (SELECT r, n, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY r, n),
kept AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
parts AS (SELECT k.r, string_agg(d.h[2 * before + 1 : 2 * a], '' ORDER BY a) AS head, max(b) AS last, sum(b - a)::BIGINT AS removed, count(*) AS n FROM kept k JOIN d ON d.r = k.r GROUP BY k.r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || h[2 * last + 1 :] END)) AS kept_sha256 FROM d LEFT JOIN parts ON parts.r = d.r
"""


def op11_packing(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT r, lang, unnest(regexp_extract_all(text, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
f1 AS MATERIALIZED (SELECT lang, x, count(*)::HUGEINT AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY lang, x),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
f2 AS MATERIALIZED (
  SELECT lang, x, y, count(*)::HUGEINT AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y FROM (SELECT lang, w, unnest(range(1, len(w))) AS i FROM w))
  GROUP BY lang, x, y HAVING count(*) >= 10),
f3 AS MATERIALIZED (
  SELECT lang, x, y, z, count(*)::HUGEINT AS f FROM (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) - 1)) AS i FROM w))
  GROUP BY lang, x, y, z HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, 1 AS cut, l.f AS l, r.f AS r FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f1 r ON r.lang = c.lang AND r.x = c.y
  UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 1, l.f, r.f FROM f3 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f2 r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z
  UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 2, l.f, r.f FROM f3 c JOIN f2 l ON l.lang = c.lang AND l.x = c.x AND l.y = c.y JOIN f1 r ON r.lang = c.lang AND r.x = c.z),
best AS (
  SELECT *, (1000000::HUGEINT * a * a) // (l * r) AS score FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY (1000000::HUGEINT * a * a) // (l * r), cut) = 1),
longer AS (SELECT lang, phrase, max(f) AS f FROM (SELECT lang, x || ' ' || y AS phrase, f FROM f3 UNION ALL SELECT lang, y || ' ' || z, f FROM f3) GROUP BY lang, phrase),
kept AS (SELECT b.* FROM best b LEFT JOIN longer i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.f IS NULL OR 100 * i.f < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def with_periodic_ends(text: Column, doc_id: Column) -> Column:
    """The text, of every tenth id by its checksum as words of which the last ones repeat: each word i from a on is word a + (i - a) % p."""
    h = F.crc32(id_text(doc_id).cast("binary"))
    g = F.floor(h / 10).cast("long")

    def made(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        block = F.slice(w, a + 1, p)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)), " ")

    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    return F.when((h % 10 == 0) & text.rlike(WORD), F.transform(F.array(words), made)[0]).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", periodic.periodic_runs(with_periodic_ends(F.col("text"), F.col("doc_id"))).alias("m")).select("doc_id", "m.runs", "m.collapsed")
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    docs = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = F.col("b")["s"], -F.col("b")["l"], F.col("b")["p"]
    return docs.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("(-1000 * b.l) div b.p").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_simhash": op1_simhash, "op2_mixing": op2_mixing, "op3_chat": op3_chat, "op4_tokens": op4_tokens, "op5_pii": op5_pii,
    "op6_quality": op6_quality, "op7_repetition": op7_repetition, "op8_decontamination": op8_decontamination, "op9_language_model": op9_language_model,
    "op10_suffix_dedup": op10_suffix_dedup, "repeated_strings": repeated_strings,
    "op11_packing": op11_packing, "op12_collocations": op12_collocations, "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {"op2_mixing": OP2_SQL, "op3_chat": OP3_SQL, "op7_repetition": OP7_SQL, "op8_decontamination": OP8_SQL, "repeated_strings": REPEATED_SQL, "op12_collocations": OP12_SQL}
