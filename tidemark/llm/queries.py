"""The registered queries of this subpackage, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, chat, html_text, language, licences, mixing, nearest, pieces, repair, repeats, similar, simhash, sketches
from tidemark.llm._shared import WORD, prepared

#: The conversation that `op4_chat_format` adds: control strings of a common template as ordinary text.
TRICKY = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(turns.unionAll(extra)))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.segmented(_table(spark, sf_dir, "documents").select("doc_id", "text"), decode_to="text")
    return rows.select(
        "doc_id", "rank", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        "log_prob", "inclusion", F.sha2("text", 256).alias("text_sha256"),
    )


def op8_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_components(_table(spark, sf_dir, "embeddings"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extracted(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_likeness(_table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(turns), turns)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(_table(spark, sf_dir, "documents"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mix, op2_nearest, op3_simhash, op4_chat_format, op5_licences, op6_language, op7_pieces, op8_similar, op9_repeats,
        op10_main_text, op11_sketches, op12_repair, op13_alignment,
    )
    return {f.__name__: f for f in found}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _op4_sql() -> str:
    control = "|".join("".join("\\" + c if c in "[]" else c for c in x) for x in chat.CONTROLS)
    length = " ".join(f"WHEN role = {_quoted(r)} THEN {len(a) + len(b)}" for r, (a, b) in chat.TEMPLATE.items())
    named = ", ".join(map(_quoted, chat.TEMPLATE))
    extra = sum(map(len, chat.OTHER))

    def escaped(x: str) -> str:
        return f"(length({x}) + len(regexp_extract_all({x}, {_quoted(control)})))"

    return f"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_quoted(TRICKY)} UNION ALL SELECT -7, 1, 'assistant', {_quoted(TRICKY)}
), said AS (
  SELECT conv_id, turn, role AS raw_role, text AS raw_text, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns
), sized AS (
  SELECT *, {escaped("text")} + CASE {length} ELSE {extra} + {escaped("role")} END AS chars FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw_text NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = {_quoted(chat.TRAINED_ROLE)}), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw_text NULLS FIRST) FILTER (role = {_quoted(chat.TRAINED_ROLE)}), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


def _op5_sql() -> str:
    sized = [(i, name, licences.bigrams_of(text), must) for i, ((name, text), must) in enumerate(zip(licences.TEMPLATES, licences.telling(), strict=True))]

    def listed(x: list[str]) -> str:
        return f"[{', '.join(map(_quoted, x))}]::VARCHAR[]"

    values = ", ".join(f"({i}, {_quoted(name)}, {listed(b)}, {listed(must)})" for i, name, b, must in sized)
    return f"""
WITH templates(template, licence, mine, must) AS (VALUES {values}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said FROM documents),
norm AS (SELECT doc_id, row_number() OVER () AS line, string_split(trim(regexp_replace(lower(said), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM lines),
pairs AS (SELECT doc_id, line, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS p FROM norm WHERE len(w) > 1),
scored AS (
  SELECT doc_id, line, template, licence, 2.0::DOUBLE * len(list_intersect(p, mine)) / (len(p) + len(mine)) AS score
  FROM pairs JOIN templates ON list_has_all(p, must) AND len(p) BETWEEN len(mine) * {licences.MIN_DICE} / (2 - {licences.MIN_DICE}) AND len(mine) * (2 - {licences.MIN_DICE}) / {licences.MIN_DICE}
), best AS (
  SELECT * FROM scored WHERE score >= {licences.MIN_DICE}
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, template) = 1
)
SELECT doc_id, count(*) AS n_lines, arg_min(licence, (-score, template)) AS licence, round(max(score), 9) AS score FROM best GROUP BY doc_id"""


_OP8_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {similar.MIN_COSINE}
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x, min(y) AS m FROM reach GROUP BY x), counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least l ON e.vec_id = l.x LEFT JOIN counts c ON e.vec_id = c.x"""


def _op11_sql() -> str:
    word, full, n = WORD, "f" * 16, sketches.WORDS

    def hashes(x: str) -> str:
        runs = f"CASE WHEN len(w) > {n} THEN [array_to_string(w[i:i + {n - 1}], ' ') FOR i IN range(1, len(w) - {n - 2})] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
        return f"(SELECT list_sort(list_distinct([left(md5(s), 16) FOR s IN r])) FROM (SELECT {runs} AS r FROM (SELECT regexp_extract_all({x}, {_quoted(word)}) AS w)))"

    def kept(x: str) -> str:
        return f"list_filter({x}, lambda h, i: h < {_quoted(sketches.LIMIT)} OR i <= {sketches.FLOOR})"

    def top(x: str) -> str:
        return f"CASE WHEN len({x}) < {sketches.FLOOR} THEN {_quoted(full)} ELSE greatest({x}[-1], {_quoted(sketches.LIMIT)}) END"

    def near(a: str, b: str) -> str:
        x, y = (f"list_filter({s}, lambda h: h <= least({top(a)}, {top(b)}))" for s in (a, b))
        both = f"len(list_intersect({x}, {y}))"
        return f"CASE WHEN len({x}) + len({y}) = 0 THEN 1.0::DOUBLE ELSE {both}::DOUBLE / (len({x}) + len({y}) - {both}) END"

    def held(a: str, b: str) -> str:
        x, y = (f"list_filter({s}, lambda h: h <= least({top(a)}, {top(b)}))" for s in (a, b))
        return f"CASE WHEN len({x}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / len({x}) END"

    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST)) AS after
  FROM docs
), made AS (
  SELECT *, left(text, length(text) - length(text) // 2) || left(after, length(text) // 2) AS edited FROM following
), sketched AS (
  SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
    {kept(hashes("text"))} AS f, {kept(hashes("edited"))} AS e, {kept(hashes("after"))} AS g
  FROM made
)
SELECT doc_id, n_chars, edited_sha256, array_to_string(f, ',') AS fingerprint, array_to_string(e, ',') AS edited_fingerprint,
  {near("f", "e")} AS near_edited, {near("f", "g")} AS near_next, {held("f", "e")} AS held_edited
FROM sketched"""


def _op12_sql() -> str:
    space = " || ".join(f"chr({ord(c)})" for c in repair.SPACE)

    def add(costs: str, cost: str, letter: str) -> str:
        """Costs in nine digits, then the audit so far: the least string is the cheapest, and ASCII-least of equals."""
        return f"(printf('%09d', left({costs}, 9)::INT + {cost}) || substr({costs}, 10) || '{letter}')"

    def closed(c: str, n: int) -> str:
        two = f"least({c}2, {add(c + '0', '3', 'I')}, {add(c + '1', '3', 'I')}, {add(c + '3', '3', 'I')})"
        return {0: f"{c}0", 1: f"{c}1", 2: two, 3: f"least({c}3, {add(two, '3', 'I')})"}[n]

    def kept(to: str, initial: str, *states: int) -> str:
        ways = [f"CASE WHEN initial = '{initial}' THEN {add(f'o{q}', 'extra', 'K')} END" for q in states]
        ways += [add(f"o{q}", "3 + extra", "R") for q in states if initial != "s"]
        return f"least({add(f'o{to}', '4', 'D')}, CASE WHEN fault IS NULL OR fault = 'truncated' THEN least({', '.join(ways)}, NULL) END)"

    return f"""
WITH RECURSIVE crc AS (
  SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) FOR i IN range(256)] AS t
), said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([ord(x) FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')],
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS draw
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM said WHERE draw <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
    rtrim(text, {space}) AS ended
  FROM damaged
), faulty AS (
  SELECT *, CASE WHEN ended = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
    WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id
), walk(conv_id, i, o0, o1, o2, o3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, '000000003I', '000000006II' FROM faulty
  UNION ALL
  SELECT conv_id, i, {", ".join(closed("n", k) for k in range(4))} FROM (
    SELECT f.conv_id, f.i, {add("o0", "4", "D")} AS n0, {kept("1", "s", 0)} AS n1, {kept("2", "u", 0, 1, 3)} AS n2, {kept("3", "a", 2)} AS n3
    FROM walk w JOIN (SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM faulty) f
      ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)
), best AS (
  SELECT w.conv_id, left(least(o0, o3), 9)::BIGINT AS cost, substr(least(o0, o3), 10) AS audit
  FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
), letters AS (
  SELECT conv_id, k, audit[k] AS edit, length(regexp_replace(audit[1:k], 'I', '', 'g')) AS i, length(regexp_replace(audit[1:k], 'D', '', 'g')) AS e
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)
), lines AS (
  SELECT l.conv_id, l.k, l.edit, l.e, f.role, f.initial, CASE WHEN l.edit = 'I' THEN '' ELSE f.text END AS text,
    max(CASE WHEN l.e = 1 AND l.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS led
  FROM letters l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i AND l.edit <> 'I'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS said
  FROM lines WHERE edit <> 'D' GROUP BY conv_id
)
SELECT d.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
  coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(r.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM d.conv_id"""


def statements() -> dict[str, str]:
    return {"op4_chat_format": _op4_sql(), "op5_licences": _op5_sql(), "op8_similar": _OP8_SQL, "op11_sketches": _op11_sql(), "op12_repair": _op12_sql()}
