"""The registered queries of the training-data operators and their SQL, for `__spark_entry__.py`."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, chat, collocations, decontam, fingerprints, hosts, ngram_join, pseudonyms, quality, sp_bpe, spelling, token_shards

SP_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.scored(_read(spark, sf_dir, "documents"), SP_MODEL)


#: Key of the pseudonyms; a deployment brings its own.
PSEUDONYM_KEY = "public-demonstration-key"


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(_read(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY, count_col="n_replaced")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the written shards, as it is read back."""
    shards = token_shards.materialise(_read(spark, sf_dir, "documents"), SP_MODEL, key=20240131)
    return token_shards.read_back(spark, shards, digests=True)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


URL_RULES = [hosts.rule("allow", "com/"), hosts.rule("block", "example.com/en/"), hosts.rule("allow", "www.example.com/en/"), hosts.rule("block", "net/es/"), hosts.rule("block", "net/fr/")]


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose id is the number in its path; the document's label is the page's outcome."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    labels = _read(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    shown = pages.select("page_id", F.expr("try_cast(regexp_extract(url, '://[^/?#]*/(?:[^/?#]*/)?([0-9]{1,18})(?:[^0-9]|$)', 1) as bigint)").alias("doc_id"))
    outcomes = shown.join(labels, "doc_id").groupBy("page_id").agg((F.min("quality") > 0).alias("good"))
    return hosts.judged(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_bpe.encode_digests(_read(spark, sf_dir, "documents"), SP_MODEL)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(_read(spark, sf_dir, "documents"))


#: The tools that the calls of `with_calls` are checked against.
TOOLS = [chat.Tool("search", {"query": "string", "limit": "integer"}, ("query",)), chat.Tool("lookup", {"key": "string"}, ("key",))]


def with_calls(conversations: DataFrame) -> DataFrame:
    """All messages of `conversations`, which has no tool calls, with calls and results made from conversation and turn.

    Every assistant's message calls one of six kinds in turn: a search that names the next call, a plain one, one
    with a wrong argument, two lookups that name each other's, and an unknown tool; every fifth conversation's messages
    another search without an identifier. Every user's message from turn 2 on brings a result for the call before it,
    in every ninth conversation for one that doesn't exist.
    """
    c = conversations.select("conv_id", "turn", "role", "text")
    k, turn = F.expr("(conv_id + turn div 2) % 6"), F.col("turn")
    name = F.when(k < 3, "search").when(k < 5, "lookup").otherwise("tally")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    args = (
        F.when(k == 0, text('{"limit":', turn, ',"query":"$c', turn + 2, '"}')).when(k == 1, text('{"limit":', turn, ',"query":"q', F.col("conv_id"), '"}'))
        .when(k == 2, text('{"limit":"many","query":"q"}')).when(k == 3, text('{"key":"$c', turn + 2, '"}')).when(k == 4, text('{"key":"$c', turn - 2, '"}')).otherwise("{}")
    )
    call = lambda i, n, a: F.struct(i.alias("id"), n.alias("name"), a.alias("arguments"))
    second = F.when(F.col("conv_id") % 5 == 0, call(F.lit(None).cast("string"), F.lit("search"), F.lit('{"query":1}')))
    made = F.to_json(F.struct(F.col("text").alias("content"), F.array_compact(F.array(call(text("c", turn), name, args), second)).alias("tool_calls")))
    spoken = c.withColumn("text", F.when((F.col("role") == "assistant") & F.col("conv_id").isNotNull() & turn.isNotNull(), made).otherwise(F.col("text")))
    answer = F.to_json(F.struct(text("r", F.col("conv_id"), "-", turn).alias("content"), F.when(F.col("conv_id") % 9 == 0, text("z", turn)).otherwise(text("c", turn - 1)).alias("tool_call_id")))
    return spoken.union(c.where("role = 'user' and turn >= 2 and conv_id is not null").select("conv_id", "turn", F.lit("tool").alias("role"), answer.alias("text")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(with_calls(_read(spark, sf_dir, "conversations")), TOOLS)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    return quality.rules(documents, quality.train(documents, _read(spark, sf_dir, "labels")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    scored = quality.classify(documents, quality.train(documents, _read(spark, sf_dir, "labels"), held_out=0))
    held_out = F.coalesce(quality.remainder("doc_id") == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.GOOD).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.of_documents(_read(spark, sf_dir, "documents"), slips=97)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(_read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_chat_format": op2_chat_format,
    "op3_quality_rules": op3_quality_rules,
    "op4_attention_lm": op4_attention_lm,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_token_shards": op6_token_shards,
    "op7_decontamination": op7_decontamination,
    "op8_host_reputation": op8_host_reputation,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fingerprints": op12_fingerprints,
    "op13_collocations": op13_collocations,
    "pipeline": pipeline,
}

def _level(name: str, children: str, parent: str) -> str:
    """Sums of counts, and the strength of the prior over the children (one-way analysis of variance)."""
    return f"""{name} AS (SELECT CASE WHEN k IS NULL OR k < 2 OR n <= k THEN 10.0 WHEN low <= 0 OR (b - w) <= 0 THEN 10000.0
      ELSE least(greatest((1 - (b - w) / low) / ((b - w) / low), 1.0), 10000.0) END AS s
    FROM (SELECT *, b + ((n - nn / n) / (k - 1) - 1) * w AS low FROM (SELECT *, CASE WHEN k > 1 AND n > k THEN (gp - g * g / n) / (k - 1) END AS b, CASE WHEN k > 1 AND n > k THEN (g - gp) / (n - k) END AS w
    FROM (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(good) AS DOUBLE) AS g, sum(CAST(n AS DOUBLE) * n) AS nn, sum(CAST(good AS DOUBLE) * good / n) AS gp FROM {children} WHERE n > 0))))"""


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_LONGEST = sorted(URL_RULES, key=lambda r: -len(r.text))
_WIDE = rf"regexp_matches(name, '(^|\.)({'|'.join(hosts.SUFFIXES)})\.[a-z]{{2}}$')"
_ADDRESS = r"(regexp_matches(name, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$') OR starts_with(name, '['))"
_LAST = "CASE WHEN len(l) > {0} THEN array_to_string(l[-{0}:], '.') ELSE name END"
#: The same levels and bound in SQL; the rules as one ladder, longest first.
_OP8 = f"""WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    try_cast(regexp_extract(url, '://[^/?#]*/(?:[^/?#]*/)?([0-9]{{1,18}})(?:[^0-9]|$)', 1) AS BIGINT) AS doc_id FROM pages),
  lab AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY 1),
  o AS (SELECT page_id, min(q) > 0 AS good FROM p JOIN lab ON lab.doc_id = p.doc_id GROUP BY 1),
  h0 AS (SELECT host, count(o.good) AS n, count(*) FILTER (o.good) AS good FROM p LEFT JOIN o ON o.page_id = p.page_id GROUP BY 1),
  h1 AS (SELECT *, string_split(name, '.') AS l FROM (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM h0)), h2 AS (SELECT *, {_WIDE} AS wide, {_ADDRESS} AS address FROM h1),
  h AS (SELECT host, n, good, CASE WHEN address THEN name WHEN wide THEN {_LAST.format(3)} ELSE {_LAST.format(2)} END AS domain, CASE WHEN address THEN name WHEN wide THEN {_LAST.format(2)} ELSE {_LAST.format(1)} END AS suffix FROM h2),
  d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY 1, 2), t AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY 1),
  g AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM t),
  {_level("sa", "t", "g")}, {_level("sb", "d", "t")}, {_level("sc", "h", "d")},
  tm AS (SELECT suffix, (good + sa.s * g.mean) / (n + sa.s) AS m FROM t, sa, g), dm AS (SELECT domain, (good + sb.s * tm.m) / (n + sb.s) AS m FROM d JOIN tm USING (suffix), sb),
  ab AS (SELECT host, good + sc.s * dm.m AS y, n - good + sc.s * (1 - dm.m) AS z FROM h JOIN dm USING (domain), sc),
  bound AS (SELECT host, y / (y + z) - {hosts.Z} * sqrt(y * z / ((y + z) * (y + z) * (y + z + 1))) AS b FROM ab)
  SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(r.host, r.path)} THEN '{r.text}'" for r in _LONGEST)} END AS rule,
    CASE {" ".join(f"WHEN {_fits(r.host, r.path)} THEN '{r.action}'" for r in _LONGEST)} WHEN b >= {hosts.LEAST} THEN 'allow' ELSE 'block' END AS verdict FROM p JOIN bound USING (host)"""

_TYPED = "json_type(args, '$.{0}') {1}"
#: The same calls and results; levels by paths of references (of up to 12 steps, as these conversations are short).
_OP2 = f"""WITH RECURSIVE src AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
  a AS (SELECT conv_id, turn, (conv_id + turn // 2) % 6 AS k FROM src WHERE role = 'assistant'),
  c0 AS (SELECT conv_id, turn, 0 AS pos, concat('c', turn) AS id, CASE WHEN k < 3 THEN 'search' WHEN k < 5 THEN 'lookup' ELSE 'tally' END AS name,
      CASE k WHEN 0 THEN concat('{{"limit":', turn, ',"query":"$c', turn + 2, '"}}') WHEN 1 THEN concat('{{"limit":', turn, ',"query":"q', conv_id, '"}}') WHEN 2 THEN '{{"limit":"many","query":"q"}}'
        WHEN 3 THEN concat('{{"key":"$c', turn + 2, '"}}') WHEN 4 THEN concat('{{"key":"$c', turn - 2, '"}}') ELSE '{{}}' END AS args FROM a
    UNION ALL SELECT conv_id, turn, 1, NULL, 'search', '{{"query":1}}' FROM a WHERE conv_id % 5 = 0),
  c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS place, list_filter(CASE name
      WHEN 'search' THEN [CASE WHEN {_TYPED.format("limit", "NOT IN ('BIGINT', 'UBIGINT')")} THEN 'limit is no integer' END, CASE WHEN {_TYPED.format("query", "IS NULL")} THEN 'missing query' WHEN {_TYPED.format("query", "<> 'VARCHAR'")} THEN 'query is no string' END]
      WHEN 'lookup' THEN [CASE WHEN {_TYPED.format("key", "IS NULL")} THEN 'missing key' WHEN {_TYPED.format("key", "<> 'VARCHAR'")} THEN 'key is no string' END] ELSE ['unknown tool'] END, lambda x: x IS NOT NULL) AS faults FROM c0),
  e AS (SELECT x.conv_id, x.place, y.place AS ref FROM (SELECT conv_id, place, unnest(regexp_extract_all(args, '"\\$([^"]+)"', 1)) AS id FROM c) x JOIN c y ON y.conv_id = x.conv_id AND y.id = x.id),
  walk AS (SELECT conv_id, place, place AS at, 0 AS hops, 0 AS forward FROM c UNION ALL SELECT w.conv_id, w.place, e.ref, hops + 1, forward + CAST(e.ref >= e.place AS INT) FROM walk w JOIN e ON e.conv_id = w.conv_id AND e.place = w.at WHERE hops < 12),
  lv AS (SELECT conv_id, place, CASE WHEN max(hops) < 12 THEN max(forward) END AS level FROM walk GROUP BY 1, 2),
  r AS (SELECT conv_id, turn, concat('r', conv_id, '-', turn) AS content, CASE WHEN conv_id % 9 = 0 THEN concat('z', turn) ELSE concat('c', turn - 1) END AS id FROM src WHERE role = 'user' AND turn >= 2),
  f AS (SELECT conv_id, id, arg_min(content, turn) AS result FROM r GROUP BY 1, 2),
  k AS (SELECT c.conv_id, c.turn, c.place, level, faults, result, concat('{{"arguments":', args, CASE WHEN len(faults) > 0 THEN concat(',"errors":', to_json(faults)) ELSE '' END, CASE WHEN c.id IS NULL THEN '' ELSE concat(',"id":"', c.id, '"') END,
      CASE WHEN level IS NULL THEN '' ELSE concat(',"level":', level) END, ',"name":"', name, '"', CASE WHEN result IS NULL THEN '' ELSE concat(',"result":"', result, '"') END, '}}') AS j
    FROM c JOIN lv ON lv.conv_id = c.conv_id AND lv.place = c.place LEFT JOIN f ON f.conv_id = c.conv_id AND f.id = c.id),
  ck AS (SELECT conv_id, floor(turn / 4096) AS part, count(*) AS n, count(result) AS linked, count(*) FILTER (len(faults) > 0) AS invalid, count(*) FILTER (level IS NULL) AS cyclic, string_agg(j, ',' ORDER BY level NULLS LAST, place) AS j FROM k GROUP BY 1, 2),
  lost AS (SELECT conv_id, floor(turn / 4096) AS part, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND c.id = r.id) GROUP BY 1, 2),
  m AS (SELECT conv_id, turn, role, text, concat('{{"content":', to_json(text), ',"role":', to_json(role), ',"turn":', turn, '}}') AS j FROM src
    UNION ALL SELECT conv_id, turn, 'tool', '', concat('{{"content":"', content, '","role":"tool","tool_call_id":"', id, '","turn":', turn, '}}') FROM r),
  mk AS (SELECT conv_id, floor(turn / 4096) AS part, count(*) AS n, string_agg(j, ',' ORDER BY turn, role, text) AS j FROM m GROUP BY 1, 2)
  SELECT mk.conv_id, CAST(mk.part AS BIGINT) AS part, CAST(0 AS BIGINT) AS piece, mk.n AS n_messages, coalesce(ck.n, 0) AS n_calls, coalesce(linked, 0) AS n_linked, coalesce(invalid, 0) AS n_invalid, coalesce(lost.n, 0) AS n_orphans, coalesce(cyclic, 0) AS n_cyclic,
    concat('{{', CASE WHEN ck.n > 0 THEN concat('"calls":[', ck.j, '],') ELSE '' END, '"conv_id":', mk.conv_id, ',"messages":[', mk.j, ']}}') AS chat
  FROM mk LEFT JOIN ck ON ck.conv_id = mk.conv_id AND ck.part = mk.part LEFT JOIN lost ON lost.conv_id = mk.conv_id AND lost.part = mk.part"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP7 = f"""WITH b AS (SELECT item_id, w, least({decontam.WIDTH}, len(w)) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
  bw AS (SELECT DISTINCT item_id, s, array_to_string(w[i : i + s - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - s + 2)) AS i FROM b)),
  d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
  dw AS (SELECT r, s, i, array_to_string(w[i : i + s - 1], ' ') AS g FROM (SELECT r, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, (SELECT DISTINCT s FROM b) WHERE len(w) >= s)),
  hit AS (SELECT r, i, dw.s, item_id FROM dw JOIN bw ON bw.g = dw.g AND bw.s = dw.s),
  n AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + s)) AS j FROM hit) GROUP BY 1),
  it AS (SELECT r, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM hit GROUP BY 1)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
  FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 by its table of 256 numbers, made here bit by bit; near words by leaving out one code point of each.
_OP11 = rf"""WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
  runs AS (SELECT id, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY 1, 2),
  coded AS (SELECT run, n, list_prepend(4294967295, flatten(list_transform(string_split(concat(id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + CAST(unicode(c) AS BIGINT) // 64, 128 + CAST(unicode(c) AS BIGINT) % 64] END))) AS b FROM runs),
  summed AS (SELECT run, n, xor(list_reduce(b, lambda s, x: xor(s // 256, tab[xor(s, x) % 256 + 1])), 4294967295) AS h FROM coded, bits),
  slipped AS (SELECT CASE WHEN h % 97 = 0 THEN concat(run[: h % length(run)], run[h % length(run) + 2 :]) ELSE run END AS word, n FROM summed),
  w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
  v AS (SELECT word, i, concat(word[: i - 1], word[i + 1 :]) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
  shorter AS (SELECT DISTINCT v.word AS long, w.word AS short FROM v JOIN w ON w.word = v.d),
  near AS (SELECT a.word, b.word AS other FROM v a JOIN v b ON a.i = b.i AND a.d = b.d AND a.word <> b.word UNION ALL SELECT long, short FROM shorter UNION ALL SELECT short, long FROM shorter),
  best AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY o.n DESC, other) AS form, max(o.n) AS form_n FROM near JOIN w o ON o.word = near.other GROUP BY 1),
  f AS (SELECT w.word, CASE WHEN form_n >= 2 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)),
  walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL),
  root AS (SELECT walk.word, walk.at AS root FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NULL)
  SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)"""

_OP13 = rf"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
  g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k)),
  f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3),
  c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
  cuts AS (SELECT c.*, cut, array_to_string(w[1 : cut], ' ') AS x, array_to_string(w[cut + 1 :], ' ') AS y FROM c, (VALUES (1), (2)) AS s(cut) WHERE cut < k),
  s AS (SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS phrase FROM c WHERE k = 3) GROUP BY 1, 2),
  t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
  kept AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR longer * 100 < a * 50)
  SELECT kept.lang, rank, phrase, a, l, r, n, score FROM kept JOIN t ON t.lang = kept.lang WHERE rank <= 2000"""

ORACLES: dict[str, str] = {"op11_spelling_variants": _OP11, "op13_collocations": _OP13, "op2_chat_format": _OP2, "op7_decontamination": _OP7, "op8_host_reputation": _OP8}
