"""SQL that equals the queries which SQL can express."""

from __future__ import annotations

from . import quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The mix: where a document lies in its source's shuffled stream, how much of it the quota's passes cover, and the
#: golden-ratio points that fall to the blocks it lies in.
MIXING = rf"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((sid - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS try FROM w),
t AS (SELECT *, least(cap, coalesce((SELECT try FROM l WHERE try <= cap / w ORDER BY cap / w, sid LIMIT 1) * w, cap)) AS target FROM l),
b AS (SELECT total, blk, CAST((total + blk - 1) // blk AS BIGINT) AS n FROM (SELECT total, least(greatest(1, total // 131072), 1048576) AS blk FROM (SELECT CAST(sum(source_size) AS BIGINT) AS total FROM s))),
q AS (SELECT t.*, blk, n, least(CAST(round(target) AS BIGINT), CAST(cap AS BIGINT)) AS quota, sum(target) OVER (ORDER BY sid) / total AS hi, coalesce(sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / total AS lo FROM t, b),
u AS (SELECT slot, ((slot + 0.5e0) * 0.6180339887498949e0) % 1.0e0 AS u FROM (SELECT unnest(range(n)) AS slot FROM b)),
r AS (SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS block FROM u JOIN q ON u >= lo AND u < hi),
a AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d),
e AS (SELECT a.doc_id, a.size, a.a, q.*, CAST(a.a // blk AS BIGINT) AS block, greatest(0, least(quota, a + size) - a) AS t0, greatest(0, least(quota, source_size + a + size) - source_size - a) AS t1, greatest(0, least(quota, 2 * source_size + a + size) - 2 * source_size - a) AS t2 FROM a JOIN q ON a.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(t0 + t1 + t2 AS BIGINT) AS taken, CAST(CASE WHEN t0 > 0 THEN coalesce(r.slot, n + e.block * (SELECT count(*) FROM s) + e.sid) END AS BIGINT) AS first_slot,
CAST(CASE WHEN t0 > 0 THEN (a + t0 - 1) // blk - a // blk + 1 ELSE 0 END + CASE WHEN t1 > 0 THEN (source_size + a + t1 - 1) // blk - (source_size + a) // blk + 1 ELSE 0 END + CASE WHEN t2 > 0 THEN (2 * source_size + a + t2 - 1) // blk - (2 * source_size + a) // blk + 1 ELSE 0 END AS BIGINT) AS n_pieces
FROM e LEFT JOIN r ON r.sid = e.sid AND r.block = e.block"""

_ESCAPED = r"regexp_replace(replace(coalesce({0}, ''), '\', '\\'), '([<\[])(/?s>|/?INST\]|image>|audio>|document>)', '\1\\\2', 'g')"

CHAT = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length({_ESCAPED.format("text")}) + length(replace({_ESCAPED.format("role")}, chr(10), '\' || chr(10))) + CASE WHEN role = 'assistant' THEN 8 ELSE 21 END) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS media_tokens FROM c GROUP BY conv_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha256(h) AS dg, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n AS payload_bytes, dg AS payload_digest, CASE WHEN n >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND f <> page_id THEN f END AS refers_to FROM d"""


def _votes() -> str:
    """The rules' votes as columns v0, v1, ... of the figures."""
    ratio = {"symbols": "n_symbols / greatest(n_words, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "capitals": "n_capitals / greatest(n_letters, 1)", "word_length": "word_chars / greatest(n_words, 1)", "letters": "n_letters / greatest(word_chars, 1)", "length": "n_words"}
    out = []
    for i, name in enumerate(quality.RULES):
        high_bad = name in quality._HIGH_IS_BAD
        good, bad = (quality._HIGH_IS_BAD if high_bad else quality._HIGH_IS_GOOD)[name]
        x = f"CAST({ratio[name]} AS DOUBLE)"
        out.append(f"CASE WHEN {x} {'<=' if high_bad else '>='} {good!r} THEN 1 WHEN {x} {'>=' if high_bad else '<='} {bad!r} THEN -1 ELSE 0 END AS v{i}")
    return ", ".join(out)


def _posterior(prefix: str = "") -> str:
    odds = " + ".join(f"CASE v{i} WHEN 1 THEN ln(g{i} / (1 - b{i})) WHEN -1 THEN ln((1 - g{i}) / b{i}) ELSE 0 END" for i in range(len(quality.RULES)))
    return f"1 / (1 + exp(-(ln(prior / (1 - prior)) + {odds})))"


def quality_sql() -> str:
    m = range(len(quality.RULES))

    def mean(right: str, voted: str, start: float) -> str:
        more = f"(2 + {quality.WEIGHT!r}::DOUBLE * coalesce(sum(n), 0))"
        return f"(coalesce(sum({right}), 0) + {more} * {start!r}::DOUBLE) / (coalesce(sum({voted}), 0) + {more})"

    start = ", ".join([f"CAST({quality.PRIOR!r} AS DOUBLE) AS prior", *[f"CAST({quality.ON_GOOD!r} AS DOUBLE) AS g{i}" for i in m], *[f"CAST({quality.ON_BAD!r} AS DOUBLE) AS b{i}" for i in m]])
    good = [mean(f"CASE WHEN v{i} > 0 THEN n * p ELSE 0 END", f"CASE WHEN v{i} <> 0 THEN n * p ELSE 0 END", quality.ON_GOOD) + f" AS g{i}" for i in m]
    bad = [mean(f"CASE WHEN v{i} < 0 THEN n * (1 - p) ELSE 0 END", f"CASE WHEN v{i} <> 0 THEN n * (1 - p) ELSE 0 END", quality.ON_BAD) + f" AS b{i}" for i in m]
    prior = mean("n * p", "n", quality.PRIOR) + " AS prior"
    rounds = []
    for k in range(quality.ROUNDS):
        rounds.append(f"e{k} AS MATERIALIZED (SELECT pat.*, {_posterior()} AS p FROM pat, m{k})")
        rounds.append(f"m{k + 1} AS MATERIALIZED (SELECT {', '.join([prior, *good, *bad])} FROM e{k})")
    window = "array_to_string(w[i:i + 7], ' ')"
    return rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
wins AS (SELECT row, i, {window} AS s FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT row, i FROM wins QUALIFY count(*) OVER (PARTITION BY row, s) > 1),
rep AS (SELECT row, count(DISTINCT pos) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS pos FROM again) GROUP BY row),
lines AS (SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, array_to_string(w, '') AS j, w, doc_id FROM d),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(j) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(j, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
CAST(length(j) - length(regexp_replace(j, '\p{{L}}+', '', 'g')) AS BIGINT) AS n_letters, CAST(len(regexp_extract_all(j, '\p{{Lu}}')) AS BIGINT) AS n_capitals, CAST(len(l) AS BIGINT) AS n_lines,
CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM lines LEFT JOIN rep USING (row)),
g AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_votes()} FROM f),
pat AS MATERIALIZED (SELECT {", ".join(f"v{i}" for i in m)}, CAST(count(*) AS DOUBLE) AS n FROM g WHERE NOT base_failed GROUP BY ALL),
m0 AS (SELECT {start}), {", ".join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_posterior()} >= 0.5 AS kept FROM g, m{quality.ROUNDS}"""




def crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes."""
    byte = "list_reduce([xor(c, b)]::BIGINT[] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    return f"xor(list_reduce([4294967295]::BIGINT[] || {values}, lambda c, b: {byte}), 4294967295)"


#: Every snapshot that gets an event, with all events so far; its sessions; those with an event of its batch.
SESSIONS = f"""WITH c AS (SELECT conv_id, turn, {crc32("CAST(conv_id AS VARCHAR)")} AS c, {crc32("conv_id || ':' || turn")} AS h FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
t AS (SELECT CAST(2 * floor(conv_id / 8) + c % 2 AS BIGINT) AS u, (c // 2) % 7200 + 300 * turn + h % 600 AS s, h, h // 600 AS g FROM c),
e AS (SELECT u, s, h, CAST(floor(s / 900) AS BIGINT) + CASE WHEN g % 5 = 0 THEN g % 4 ELSE 0 END AS b FROM t),
x AS (SELECT k.b AS batch, e.* FROM (SELECT DISTINCT u, b FROM e) k JOIN e ON e.u = k.u AND e.b <= k.b),
y AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY u, batch ORDER BY s) <= 600 THEN 0 ELSE 1 END AS cut FROM x),
z AS (SELECT *, sum(cut) OVER (PARTITION BY u, batch ORDER BY s) AS part FROM y),
v AS (SELECT u, batch, min(s) AS s0, max(s) AS s1, count(*) AS n, count(*) FILTER (b = batch) AS n_new, sum(h) AS h_sum FROM z GROUP BY u, batch, part HAVING n_new > 0),
r AS (SELECT o.u, o.batch, o.s0, min_by(struct_pack(b := w.batch, s := w.s0), w.batch) AS heir FROM v o JOIN v w ON w.u = o.u AND w.batch > o.batch AND o.s0 BETWEEN w.s0 AND w.s1 GROUP BY ALL),
k AS (SELECT u, heir, count(*) AS n FROM r GROUP BY ALL)
SELECT v.u AS "user", v.batch, v.s0 AS start_s, v.s1 AS end_s, v.n AS n_events, v.n_new, coalesce(k.n, 0) AS n_retracted, CAST(v.h_sum AS BIGINT) AS h_sum, r.heir.b AS retracted_batch, r.heir.s AS retracted_start_s
FROM v LEFT JOIN r ON r.u = v.u AND r.batch = v.batch AND r.s0 = v.s0 LEFT JOIN k ON k.u = v.u AND k.heir.b = v.batch AND k.heir.s = v.s0"""

#: Words that leave the same when a code point at the same place is cut out, or of which one is what the other leaves.
SPELLING = f"""WITH RECURSIVE t AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS MATERIALIZED (SELECT doc_id, run, CAST(length(run) AS BIGINT) AS l, count(*) AS m FROM t WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT *, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM k),
w AS MATERIALIZED (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % l) || substr(run, h % l + 2) ELSE run END AS word, CAST(sum(m) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(m) >= 3),
d AS MATERIALIZED (SELECT word, length(word) AS l, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word AS a, y.word AS b FROM d x JOIN d y ON x.l = y.l AND x.i = y.i AND x.rest = y.rest AND x.word <> y.word UNION SELECT x.word, y.word FROM d x JOIN w y ON x.rest = y.word UNION SELECT y.word, x.word FROM d x JOIN w y ON x.rest = y.word),
b AS (SELECT a, b, w.n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS r FROM p JOIN w ON w.word = b),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * w.n THEN b END AS form, CASE WHEN b.n >= 2 * w.n THEN b.n END AS form_n FROM w LEFT JOIN b ON b.a = w.word AND r = 1),
g AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, g.root FROM g JOIN f ON f.form = g.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN g USING (word)"""

ORACLE = {"op11_spelling": SPELLING, "op13_late_sessions": SESSIONS, "op2_mixing": MIXING, "op6_chat": CHAT, "op7_quality": quality_sql(), "op10_warc": WARC}
