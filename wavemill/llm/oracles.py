"""SQL of the queries that SQL expresses, over whole tables."""

from __future__ import annotations

from wavemill.llm import mixing, quality
from wavemill.llm.queries import MIXTURE

BLANK = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINES = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM split),
keyed AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
repeated AS (SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT d.doc_id, d.i, d.line, coalesce(d.doc_id < r.last_id, false) AS gone FROM keyed d LEFT JOIN repeated r ON d.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

MIXING = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, coalesce('s:' || source, 'null') AS s, coalesce(length(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS t FROM documents),
totals AS (SELECT s, sum(t)::BIGINT AS total, count(*) AS n_docs FROM docs GROUP BY s HAVING sum(t) > 0),
shares AS (SELECT s, total, n_docs, total::DOUBLE / sum(total) OVER () AS p, sum(total) OVER ()::BIGINT AS budget FROM totals),
step(n, lo, hi, rlo, rhi) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE
    UNION ALL
    SELECT n + 1, CASE WHEN e >= {MIXTURE["target_entropy"]} * m THEN (lo + hi) / 2 ELSE lo END, CASE WHEN e >= {MIXTURE["target_entropy"]} * m THEN hi ELSE (lo + hi) / 2 END,
           CASE WHEN r > {MIXTURE["max_repeats"]} THEN (rlo + rhi) / 2 ELSE rlo END, CASE WHEN r > {MIXTURE["max_repeats"]} THEN rhi ELSE (rlo + rhi) / 2 END
    FROM (SELECT *, (SELECT ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * (lo + hi) / 2 * ln(p)) / sum(pow(p, (lo + hi) / 2)) FROM shares) AS e,
                 (SELECT max(pow(p, (rlo + rhi) / 2 - 1)) / sum(pow(p, (rlo + rhi) / 2)) FROM shares) AS r, (SELECT ln(count(*)) FROM shares) AS m FROM step WHERE n < {mixing.STEPS})),
found AS (SELECT round(greatest(CASE WHEN (SELECT -sum(p * ln(p)) >= {MIXTURE["target_entropy"]} * ln(count(*)) FROM shares) THEN 1.0 ELSE lo END,
                                CASE WHEN (SELECT max(1 / p) / count(*) > {MIXTURE["max_repeats"]} FROM shares) THEN rhi ELSE 0.0 END), 9) AS a FROM step WHERE n = {mixing.STEPS}),
weights AS (SELECT s, total, n_docs, budget, a AS exponent, pow(p, a) / (SELECT sum(pow(p, f.a)) FROM shares, found f) AS exact FROM shares, found),
quotas AS (SELECT *, round(exact, 9) AS weight, least(greatest(floor(exact * budget), 1), floor(total * {MIXTURE["max_repeats"]}))::BIGINT AS quota FROM weights),
copies AS (SELECT d.*, q.total, q.n_docs, q.quota, q.weight, q.exponent, unnest(range(ceil(q.quota / q.total)::BIGINT))::INTEGER AS epoch FROM docs d JOIN quotas q ON d.s = q.s WHERE q.quota > 0),
tagged AS (SELECT *, md5('0:' || epoch || ':' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM copies),
blocked AS (SELECT *, ('0x' || h[1:15])::BIGINT % ceil(greatest(total, n_docs) / {mixing.BLOCK_TOKENS})::BIGINT AS b FROM tagged),
placed AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY s, epoch ORDER BY b, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM blocked)
SELECT doc_id, source, epoch, position, t AS tokens, weight, exponent FROM placed WHERE position < quota - epoch * total
"""


def _quality() -> str:
    symbols = " + ".join(f"length(t) - length(replace(t, '{c}', ''))" for c in "#*$%&|<>")
    measures = "\n    UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, ({e.replace(' div ', ' // ')})::BIGINT AS v FROM base WHERE NOT base_failed AND n_words > 0" for m, (e, _) in quality.MEASURES.items())
    limits = ", ".join(
        f"max(q1 - 3 * (q3 - q1) - {slack}) FILTER (measure = '{m}') AS {m}_lo, max(q3 + 3 * (q3 - q1) + {slack}) FILTER (measure = '{m}') AS {m}_hi" for m, (_, slack) in quality.MEASURES.items()
    )
    within = " AND ".join(f"({e.replace(' div ', ' // ')}) BETWEEN f.{m}_lo AND f.{m}_hi" for m, (e, _) in quality.MEASURES.items())

    def level(name: str, keys: str) -> str:
        group = f"{keys}, measure" if keys else "measure"
        return f"""{name} AS (SELECT {group}, max(total) AS total, min(top) FILTER (cum * 4 >= total) AS q1, min(top) FILTER (cum * 4 >= total * 3) AS q3
    FROM (SELECT *, sum(n) OVER (PARTITION BY {group} ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY {group}) AS total,
                 CASE WHEN bin < 64 THEN bin ELSE ((bin - 64) % 32 + 33) * (1::BIGINT << ((bin - 64) // 32 + 1)) - 1 END AS top
          FROM (SELECT {group}, bin, count(*) AS n FROM binned GROUP BY {group}, bin)) GROUP BY {group})"""

    return f"""
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w FROM docs),
spots AS (SELECT doc_id, unnest(range(1, length(w) - 6)) AS i, w FROM words WHERE length(w) >= 8),
windows AS (SELECT doc_id, i, w[i:i + 7] AS x FROM spots),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
repeats AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs),
dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
counted AS (SELECT x.doc_id, lang, source, length(w)::BIGINT AS n_words, length(regexp_replace(t, '{BLANK}', '', 'g'))::BIGINT AS word_chars, ({symbols})::BIGINT AS n_symbols,
                   coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
            FROM words x LEFT JOIN dups ON x.doc_id = dups.doc_id LEFT JOIN repeats ON x.doc_id = repeats.doc_id),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
stacked AS ({measures}),
binned AS (SELECT *, CASE WHEN v < 64 THEN v ELSE 64 + (length(bin(v)) - 7) * 32 + (v >> (length(bin(v)) - 6)) - 32 END AS bin FROM stacked),
{level("fine", "lang, source")},
{level("of_lang", "lang")},
{level("of_all", "")},
chosen AS (SELECT f.lang, f.source, f.measure, CASE WHEN f.total >= 50 THEN f.q1 WHEN l.total >= 50 THEN l.q1 ELSE a.q1 END AS q1,
                  CASE WHEN f.total >= 50 THEN f.q3 WHEN l.total >= 50 THEN l.q3 ELSE a.q3 END AS q3
           FROM fine f JOIN of_lang l ON f.lang IS NOT DISTINCT FROM l.lang AND f.measure = l.measure JOIN of_all a ON f.measure = a.measure),
fences AS (SELECT lang, source, {limits} FROM chosen GROUP BY lang, source)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({within}, false) AS kept
FROM base b LEFT JOIN fences f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""


CRC_TABLE = "[list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)]"


def _dialogue() -> str:
    """Cheapest edits by states, from the last row to the first: lists of (cost, audit, repaired lines), compared in that order."""
    role, after = ["user", "user", "assistant", "user"], [2, 2, 3, 2]
    keep = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]

    def edit(state: int, cost: str, letter: str, line: str | None) -> str:
        b = f"b[{state + 1}]"
        return f"struct_pack(c := {b}.c + {cost}, a := '{letter}' || {b}.a, t := {b}.t)" if line is None else f"struct_pack(c := {b}.c + {cost}, a := '{letter}' || {b}.a, t := list_prepend({line}, {b}.t))"

    def inserted(q: int) -> str:
        one, two = after[q], after[after[q]]
        lines = f"'{role[q]}:', '{role[one]}:'"
        double = f"struct_pack(c := b[{two + 1}].c + 4, a := 'II' || b[{two + 1}].a, t := list_concat([{lines}], b[{two + 1}].t))"
        return f"list_min([b[{q + 1}], {edit(one, '2', 'I', lines.split(', ')[0])}, {double}])"

    def taken(q: int) -> str:
        kept = " ".join(f"WHEN i = '{c}' THEN {edit(to, 'late', 'K', 'line')}" for c, to in keep[q].items())
        gone = edit(q, "3", "D", None)
        other = edit(after[q], "2 + late", "R", f"'{role[q]}:' || body")
        return f"CASE WHEN must THEN {gone} ELSE list_min([{gone}, CASE {kept} ELSE {gone} END, {other}]) END"

    insert, take = (", ".join(f(q) for q in range(4)) for f in (inserted, taken))
    none = "struct_pack(c := 1000000000::BIGINT, a := '', t := []::VARCHAR[])"
    end = "struct_pack(c := 0::BIGINT, a := '', t := []::VARCHAR[])"
    return f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT {CRC_TABLE} AS tab),
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
fated AS (SELECT g.*, xor(list_reduce(list_prepend(4294967295, [ord(x)::BIGINT FOR x IN string_split(s, '')]), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS fate FROM given g, tab),
hurt AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fated),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || chr(10) || text), copy) AS k, regexp_replace(text, '{BLANK}+$', '') AS seen FROM hurt),
marked AS (SELECT *, seen = '' AS blank, seen <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS twice, left(role, 1) AS i,
                  left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) || left(role, 1) AS pair FROM placed),
judged AS (SELECT *, blank OR twice AS must, NOT (blank OR twice) AND right(seen, 1) NOT IN ('.', '!', '?') AS cut FROM marked),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (twice) AS duplicate,
                   count(*) FILTER (cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM judged GROUP BY conv_id),
best(conv_id, k, b) AS (
    SELECT conv_id, n, [{insert}] FROM (SELECT conv_id, n, [{end}, {none}, {none}, {end}] AS b FROM counted)
    UNION ALL
    SELECT conv_id, k - 1, [{insert}] FROM (SELECT conv_id, k, [{take}] AS b FROM (
        SELECT x.conv_id, x.k, x.b, j.i, j.must, j.cut::BIGINT AS late, j.role || ':' || j.text AS line, j.text AS body FROM best x JOIN judged j ON x.conv_id IS NOT DISTINCT FROM j.conv_id AND x.k = j.k)))
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b[1].c, 0) AS cost, coalesce(b[1].a, '') AS audit, sha256(coalesce(array_to_string(b[1].t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best x ON a.conv_id IS NOT DISTINCT FROM x.conv_id AND x.k = 0
"""


#: Digests of all strings of 200 bytes (400 hex digits); runs of places less than a string apart are one span.
REPEATS = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(coalesce(text, '')) AS h FROM documents),
strings AS MATERIALIZED (SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS m FROM (SELECT r, h, unnest(range(length(h) // 2 - 199)) AS p FROM docs WHERE length(h) >= 400)),
again AS (SELECT m FROM strings GROUP BY m HAVING count(*) > 1),
hits AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 200, true)::INT AS fresh FROM strings WHERE m IN (SELECT m FROM again)),
spans AS (SELECT r, min(p) AS s, max(p) + 200 AS e FROM (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS k FROM hits) GROUP BY r, k),
edges AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM spans),
cut AS (SELECT d.r, count(*) AS n_spans, sum(e - s) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(max(h), 2 * max(e) + 1) AS kept FROM edges JOIN docs d ON d.r = edges.r GROUP BY d.r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM docs d LEFT JOIN cut c ON d.r = c.r
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_mixing": MIXING, "op8_lines": LINES, "op10_quality": _quality(), "op11_dialogue": _dialogue(), "op12_repeats": REPEATS}
