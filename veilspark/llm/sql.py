"""DuckDB statements that give the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from . import license_scan as licenses
from . import quality_rules as rules

SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def quality_rules() -> str:
    metrics = {
        "n_words": "n_words", "mean_word_length": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(n_words, 1)", "stop_ratio": "n_stop / greatest(n_words, 1)",
        "upper_ratio": "n_upper / greatest(word_chars, 1)", "stutter_ratio": "n_stutter / greatest(n_words, 1)",
        "duplicate_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
        "bullet_line_ratio": "n_bullet / greatest(n_lines, 1)", "ellipsis_line_ratio": "n_ellipsis / greatest(n_lines, 1)"}
    tests = [f"{metrics[r.metric]} {op} {x}" for r in rules.RULES for op, x in ((">=", r.low), ("<=", r.high)) if x is not None]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
c AS (SELECT rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             len(list_filter(ws, lambda x: x IN ({quoted(rules.STOP_FORMS)})))::BIGINT AS n_stop,
             len(list_filter(ws, lambda x, i: i > 1 AND x = ws[i - 1]))::BIGINT AS n_stutter,
             length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*+] ')))::BIGINT AS n_bullet,
             len(list_filter(ls, lambda x: suffix(x, '...') OR suffix(x, '…')))::BIGINT AS n_ellipsis FROM w),
p AS (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + 7], ' ')) AS n FROM p),
r AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM g WHERE n > 1),
s AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM r GROUP BY rid),
f AS (SELECT c.*, coalesce(s.n, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN s USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(tests)} AS kept FROM b"""


ALNUM_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
               r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


def decontamination() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ALNUM_WORDS} AS ws FROM documents),
t AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {ALNUM_WORDS} AS ws FROM benchmark),
v AS (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS j FROM t WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(ws[j:j + n - 1], ' ') AS s FROM v),
p AS (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n),
h AS (SELECT rid, i, p.n, item FROM p JOIN win ON p.n = win.n AND array_to_string(ws[i:i + p.n - 1], ' ') = s),
w AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rid),
m AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM h GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w USING (rid) LEFT JOIN m USING (rid)"""


def entropy_balance() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, len({SPACE_WORDS})::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS o1, md5(coalesce(text, '')) AS o2 FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS tokens FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w,
             2.0::DOUBLE * tokens AS top FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(tokens) OVER () - coalesce(sum(top) OVER b, 0)) / sum(w) OVER a AS level, top / w AS need FROM w
      WINDOW b AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             a AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT source, tokens, least(top, coalesce(max(CASE WHEN level <= need THEN level END) OVER () * w, top)) AS target FROM l),
k AS (SELECT source, CASE WHEN size < 1024 THEN size ELSE length(bin(size)) * 128 + (size >> (length(bin(size)) - 7)) END AS class,
             count(*) AS n, sum(size)::BIGINT AS tokens FROM d GROUP BY ALL),
q AS (SELECT k.*, row_number() OVER (PARTITION BY k.source ORDER BY class DESC) AS step, t.target, t.tokens AS source_size
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
f AS (SELECT source, 0::BIGINT AS step, NULL::BIGINT AS class, 0::BIGINT AS n, 0::BIGINT AS c, target::DOUBLE AS want, tokens::BIGINT AS lft FROM t
      UNION ALL
      SELECT source, step, class, n, c, want - c * (tokens::DOUBLE / n), (lft - tokens)::BIGINT FROM (
        SELECT q.source, q.step, q.class, q.n, q.tokens, f.want, f.lft,
               greatest(0, least(CASE WHEN f.lft > 0 THEN round(q.n * f.want / f.lft) ELSE 0 END, 2 * q.n))::BIGINT AS c
        FROM f JOIN q ON f.source IS NOT DISTINCT FROM q.source AND q.step = f.step + 1)),
o AS (SELECT d.*, t.tokens AS source_size, t.target, f.n, f.c,
             row_number() OVER (PARTITION BY d.source, f.class ORDER BY o1, o2) - 1 AS rnk
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
             JOIN f ON d.source IS NOT DISTINCT FROM f.source
                   AND f.class = CASE WHEN size < 1024 THEN size ELSE length(bin(size)) * 128 + (size >> (length(bin(size)) - 7)) END)
SELECT doc_id, size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
       ((c // n + CASE WHEN rnk < c % n THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM o"""


def license_scan() -> str:
    values = ", ".join(f"({quoted([anchor])}, {quoted([f'^(?:{pattern})( |$)'])}, {quoted([label])}, {priority}, {order})"
                       for anchor, pattern, label, priority, order in licenses.RULES)
    base = ", ".join(f"({quoted([phrase])}, {len(phrase.split())}, {quoted([label])})" for phrase, label in licenses.BASE)
    anchors = quoted(sorted({r[0] for r in licenses.RULES} | {phrase.split()[0] for phrase, _ in licenses.BASE}))
    return rf"""
WITH rules(anchor, re, label, priority, ord) AS (VALUES {values}),
base(phrase, n, label) AS (VALUES {base}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT rid, ws, unnest(range(0, len(ws))) AS i FROM d),
x AS (SELECT rid, i, ws[i + 1] AS w, array_to_string(ws[i + 1:i + {licenses.REACH}], ' ') AS ctx FROM p WHERE ws[i + 1] IN ({anchors})),
h AS (SELECT rid, i, i + len(string_split(trim(regexp_extract(ctx, re, 0)), ' ')) AS stop, label, priority, ord
      FROM x JOIN rules ON w = anchor WHERE regexp_extract(ctx, re, 0) <> ''),
k AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h AS g WHERE g.rid = h.rid AND g.i <= h.i AND g.stop >= h.stop AND g.ord <> h.ord
      AND (g.priority > h.priority OR (g.priority = h.priority AND ((g.stop - g.i > h.stop - h.i)
           OR (g.stop - g.i = h.stop - h.i AND g.ord < h.ord)))))),
b AS (SELECT rid, i, label FROM x JOIN base ON starts_with(ctx || ' ', phrase || ' ')),
bs AS (SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM b GROUP BY rid),
al AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS ls FROM (SELECT rid, label FROM b UNION ALL SELECT rid, label FROM k) GROUP BY rid),
ks AS (SELECT rid, max(priority) AS best FROM k GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(bs.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(bs.ls, '') AS base_labels, coalesce(al.ls, '') AS labels, coalesce(best / 10, 0.0)::DOUBLE AS score
FROM d LEFT JOIN bs USING (rid) LEFT JOIN al USING (rid) LEFT JOIN ks USING (rid)"""


CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
                                                lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS of)"""


def crc32(text: str) -> str:
    """CRC-32 of a text of code points up to U+00FF, with the table ``crc`` at hand."""
    octets = (f"flatten(list_transform(string_split({text}, ''), lambda x: "
              "CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]::BIGINT[] END))")
    return (f"xor(list_reduce(list_prepend(4294967295, {octets}), "
            "lambda c, b: xor(c >> 8, crc.of[(xor(c, b) & 255) + 1])), 4294967295)")


def conversation_repair() -> str:
    """All cheapest repairs by state, with their whole audits and texts, row after row."""
    def edit(state: int, letter: str, cost: str, added: str = "''", only: str = "true") -> str:
        return (f"{{'c': q[{state + 1}].c + {cost} + CASE WHEN {only} THEN 0 ELSE 1000000 END, 'a': q[{state + 1}].a || '{letter}', "
                f"'t': q[{state + 1}].t || {added}}}")

    def least(edits: list[str]) -> str:
        return f"list_min([{', '.join(edits)}])"

    message = "chr(10) || {} || ':' || text"
    free, extra = "(fault IS NULL OR fault = 'truncated')", "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    taken = []
    for state in range(4):
        edits = [edit(state, "D", "2")]
        edits += [edit(s, "K", extra, message.format("role"), f"{free} AND left(role, 1) = '{initial}'")
                  for s, initial, to in ((0, "s", 1), (0, "u", 2), (1, "u", 2), (3, "u", 2), (2, "a", 3)) if to == state]
        edits += [edit(s, "R", f"1 + {extra}", message.format(f"'{role}'"), free)
                  for s, role, to in ((0, "user", 2), (1, "user", 2), (3, "user", 2), (2, "assistant", 3)) if to == state]
        taken.append(least(edits))
    user = least(["q[3]", *(edit(s, "I", "5", "chr(10) || 'user:'") for s in (0, 1, 3))])
    assistant = least(["q[4]", edit(2, "I", "5", "chr(10) || 'assistant:'")])
    return rf"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k.*, {crc32("key")} % 20 AS f FROM k, crc),
d AS (SELECT rid, conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
             CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS nth FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rid, nth) AS rn,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, nth) AS seen FROM d),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) || left(role, 1) AS pair FROM n),
walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS rn, [{{'c': 0, 'a': '', 't': ''}}, {{'c': 1000000, 'a': '', 't': ''}},
         {{'c': 5, 'a': 'I', 't': chr(10) || 'user:'}}, {{'c': 10, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}] AS q
  FROM conversations
  UNION ALL
  SELECT conv_id, rn, [q[1], q[2], q[3], {assistant}] AS q FROM (
    SELECT conv_id, rn, [q[1], q[2], {user}, q[4]] AS q FROM (
      SELECT walk.conv_id, r.rn, [{", ".join(taken)}] AS q
      FROM walk JOIN r ON r.conv_id IS NOT DISTINCT FROM walk.conv_id AND r.rn = walk.rn + 1))),
e AS (SELECT conv_id, list_min([q[1], q[4]]) AS x FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) = 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'blank')::BIGINT AS blank,
             count_if(fault = 'duplicate')::BIGINT AS duplicate, count_if(fault = 'truncated')::BIGINT AS truncated,
             count_if(pair NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM r GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, x.c::BIGINT AS cost, x.a AS audit,
       sha256(x.t[2:]) AS repaired_sha256
FROM e LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


def spelling_variants() -> str:
    """Near words as words that agree once a letter of both, or of the longer one, is left out."""
    return rf"""
WITH RECURSIVE {CRC_TABLE},
o AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT run, id || ':' || run AS key, count(*) AS k FROM o GROUP BY ALL),
h AS (SELECT run, k, {crc32("key")} AS h FROM g, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
s AS (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
x AS (SELECT a.word, b.word AS near, b.n AS near_n FROM s a JOIN s b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
      UNION (SELECT v.word, s.word, s.n FROM v JOIN s ON v.word = s.rest)
      UNION (SELECT s.word, v.word, v.n FROM v JOIN s ON v.word = s.rest)),
c AS (SELECT word, count(*) AS n_near FROM x GROUP BY word),
b AS (SELECT word, near, near_n FROM x QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
f AS (SELECT v.word, v.n, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next)
SELECT f.word, form, r.at AS root, f.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM f JOIN r ON r.word = f.word AND r.next IS NULL LEFT JOIN c ON c.word = f.word"""
