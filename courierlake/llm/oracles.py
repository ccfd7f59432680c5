"""DuckDB SQL of the corpus queries that SQL can express, over the whole tables."""

from __future__ import annotations

from . import cover_dedup, ngram_join, spelling_variants
from . import quality_rules as rules

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def repeated_windows() -> str:
    """op4: each window's first place in order of document and start; words under any other go."""
    n = cover_dedup.WINDOW
    return f"""WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
    win AS (SELECT doc_id, i, array_to_string(words[i:i + {n - 1}], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - {n - 2})) AS i FROM w)),
    first AS (SELECT win, min(struct_pack(d := doc_id, i := i)) AS f FROM win GROUP BY win HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM win JOIN first USING (win) WHERE doc_id != f.d OR i != f.i),
    p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
    told AS (SELECT p.doc_id, count(gone.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p.i) FILTER (gone.i IS NULL), '') AS kept FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY 1)
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN told USING (doc_id)"""


def common_bytes(least: int = 50) -> str:
    """op7: bytes under a string that a document with a smaller id has; what stays is what lies between such strings."""
    return f"""WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    win AS (SELECT doc_id, i, b[i + 1:i + {least}] AS win FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - {least - 1})) AS i FROM b)),
    first AS (SELECT win, min(doc_id) AS d FROM win GROUP BY win HAVING min(doc_id) < max(doc_id)),
    hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM win JOIN first USING (win) WHERE doc_id > d),
    part AS (SELECT doc_id, i, last, least({least}, i + {least} - coalesce(last + {least}, 0)) AS new, last IS NULL OR i > last + {least} AS opens, hex(b[coalesce(last + {least}, 0) + 1:i]) AS before FROM hit JOIN b USING (doc_id)),
    told AS (SELECT doc_id, sum(least({least}, CASE WHEN last IS NULL THEN {least} ELSE i - last END)) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(before, '' ORDER BY i) FILTER (opens) AS kept, max(i) AS top FROM part GROUP BY 1)
    SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
      CASE WHEN top IS NULL THEN sha256(b) ELSE sha256(unhex(kept || hex(b[top + {least} + 1:octet_length(b)]))) END AS kept_sha256 FROM b LEFT JOIN told USING (doc_id)"""


def jaccard() -> str:
    """op8: all pairs that share an n-gram, and their components."""
    n, (up, down) = ngram_join.N, ngram_join.THRESHOLD
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS words FROM documents),
    classes AS (SELECT array_to_string(words, ' ') AS t, any_value(words) AS words, min(doc_id) AS rep, count(*) AS copies FROM w GROUP BY 1),
    grams AS (SELECT DISTINCT rep, copies, unnest(CASE WHEN len(words) >= {n} THEN [array_to_string(words[i:i + {n - 1}], ' ') FOR i IN range(1, len(words) - {n - 2})] WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram FROM classes),
    sized AS (SELECT *, count(*) OVER (PARTITION BY rep) AS size FROM grams),
    pairs AS (SELECT a.rep AS a, b.rep AS b, any_value(b.copies) AS copies FROM sized a JOIN sized b ON a.gram = b.gram AND a.rep != b.rep GROUP BY 1, 2 HAVING count(*) * {down} >= (any_value(a.size) + any_value(b.size) - count(*)) * {up}),
    reach AS (SELECT rep, rep AS root FROM classes UNION SELECT reach.rep, pairs.b FROM reach JOIN pairs ON reach.root = pairs.a),
    roots AS (SELECT rep, min(root) AS class_id FROM reach GROUP BY 1),
    links AS (SELECT a AS rep, sum(copies) AS documents, count(*) AS texts FROM pairs GROUP BY 1)
    SELECT doc_id, class_id, rep, CAST(coalesce(documents, 0) + copies - 1 AS BIGINT) AS n_links, CAST(coalesce(texts, 0) AS BIGINT) AS n_text_links
    FROM w JOIN classes ON array_to_string(w.words, ' ') = t JOIN roots USING (rep) LEFT JOIN links USING (rep)"""


def chats(planted: str) -> str:
    """op9: turns in order, what the assistant says, and the length of the built-in template's output."""
    order = "ORDER BY turn NULLS FIRST, role, text"
    said = planted.replace("'", "''")

    def escaped(column: str, signs: str) -> str:
        return f"2 * length({column}) - length(regexp_replace({column}, '{signs}', '', 'g'))"

    return rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '{said}', NULL), (-7, 1, 'assistant', '{said}', NULL))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum({escaped('role', r'[\\#<:]')} + {escaped('text', r'[\\#<]')} + {len('### : </turn>') + 1}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id, alone"""


def warc() -> str:
    """op10: SHA-1 in base 32, five hexadecimal digits giving four of base 32, and the first page of each payload."""
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    d AS (SELECT page_id, octet_length(encode(html)) AS n, array_to_string([substr('{DIGITS}', 1 + ((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31), 1) FOR k IN range(32)], '') AS digest FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != first THEN first END AS refers_to FROM f"""


def divergence() -> str:
    """op6: the base counts, and both Jensen-Shannon distances against the references of the likeliest language."""
    points = r".,;:!?''\"()\-".replace('\\"', '"')

    def count(signs: str) -> str:
        return f"(length(text) - length(regexp_replace(text, '{signs}', '', 'g')))"

    def shares(lang: str) -> str:
        listed = [f"len([x FOR x IN words IF x = '{w}' OR x = '{w.capitalize()}']) / greatest(len(words), 1)::DOUBLE" for w in rules.COMMON_WORDS[lang]]
        return f"[{', '.join(listed)}]"

    def distance(p: str, q: str) -> str:
        part = "CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END"
        a, b, m = f"{p}[i]", f"{q}[i]", f"(({p}[i] + {q}[i]) / 2)"
        return f"sqrt(greatest(list_sum([({part.format(a)} + {part.format(b)}) / 2 - {part.format(m)} FOR i IN range(1, len({p}) + 1)]), 0))"

    langs = list(rules.COMMON_WORDS)
    best = " ".join(f"WHEN list_sum(s_{x}) = top THEN {{{i}}}" for i, x in enumerate(langs))
    classes = best.format(*(f"{list(rules.CHAR_CLASSES[x])}::DOUBLE[]" for x in langs))
    own = best.format(*(f"s_{x} || [greatest(1 - list_sum(s_{x}), 0)]" for x in langs))
    usual = best.format(*(f"{[*rules.COMMON_WORDS[x].values(), 1 - sum(rules.COMMON_WORDS[x].values())]}::DOUBLE[]" for x in langs))

    def allowed(limit: tuple[float, float], n: str) -> str:
        return f"{limit[0]}::DOUBLE + {limit[1]}::DOUBLE / sqrt(greatest({n}, 1))"

    return rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
    win AS (SELECT doc_id, i, array_to_string(words[i:i + {rules.WINDOW - 1}], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - {rules.WINDOW - 2})) AS i FROM w)),
    twice AS (SELECT doc_id, win FROM win GROUP BY 1, 2 HAVING count(*) > 1),
    again AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {rules.WINDOW})) AS i FROM win JOIN twice USING (doc_id, win)) GROUP BY 1),
    m AS (SELECT doc_id, words, length(text) AS n_chars, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, {count('[#*$%&|<>]')} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
      {count(chr(92) + 'p{Lu}')} AS capitals, {count(chr(92) + 'p{Nd}')} AS digits, {count(f'[{points}]')} AS points, {count(rf'[^\p{{L}}\p{{Nd}}\x20\x09-\x0D{points}]')} AS others,
      {', '.join(f'{shares(x)} AS s_{x}' for x in langs)} FROM w LEFT JOIN again USING (doc_id)),
    t AS (SELECT *, greatest({', '.join(f'list_sum(s_{x})' for x in langs)}) AS top, [x / greatest(n_chars, 1)::DOUBLE FOR x IN [word_chars - capitals - digits - points - others, capitals, digits, n_chars - word_chars, points, others]] AS by_class FROM m),
    r AS (SELECT *, CASE {classes} END AS class_reference, CASE {own} END AS by_word, CASE {usual} END AS word_reference FROM t),
    d AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed, CASE WHEN n_chars >= {rules.MIN_CHARS} THEN {distance('by_class', 'class_reference')} END AS char_distance, CASE WHEN n_words >= {rules.MIN_WORDS} THEN {distance('by_word', 'word_reference')} END AS word_distance FROM r)
    SELECT doc_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in ('n_words', 'word_chars', 'n_symbols', 'n_dup_lines', 'n_repeat_words'))}, failed AS base_failed,
      NOT failed AND coalesce(char_distance <= {allowed(rules.CHAR_DISTANCE, 'n_chars')}, true) AND coalesce(word_distance <= {allowed(rules.WORD_DISTANCE, 'n_words')}, true) AS kept FROM d"""


def checksums(source: str, key: str) -> str:
    """CTEs `bits` and `summed`: source's rows with h, the CRC-32 of the UTF-8 of column `key` (code points below U+0800)."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END"
    return f"""bits AS (SELECT list(list_reduce([i::UBIGINT] || [0::UBIGINT FOR k IN range(8)], lambda c, k: {step}) ORDER BY i) AS t FROM range(256) AS r(i)),
    summed AS (SELECT *, xor(list_reduce([4294967295::UBIGINT] || flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)::UBIGINT] ELSE [(192 | (unicode(x) >> 6))::UBIGINT, (128 | (unicode(x) & 63))::UBIGINT] END FOR x IN string_split({key}, '')]),
      lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255::UBIGINT AS BIGINT) + 1])), 4294967295::UBIGINT) AS h FROM {source}, bits)"""


def spelling() -> str:
    """op12: words that agree but for one place, or but for one left out; forms followed to the last."""
    least, count = spelling_variants.LEAST_CHARS, spelling_variants.LEAST_COUNT
    return rf"""WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS times, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling_variants.UPPER}', '{spelling_variants.UPPER.lower()}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY 1, 2),
    {checksums('runs', 'key')},
    v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (SELECT times, CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM summed) WHERE length(word) >= {least} GROUP BY 1 HAVING sum(times) >= {count}),
    less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
    near AS (SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word != b.word
      UNION SELECT less.word, v.word, v.n FROM less JOIN v ON rest = v.word UNION SELECT v.word, less.word, less.n FROM less JOIN v ON rest = v.word),
    best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -n, near := near)) AS b FROM near GROUP BY 1),
    told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * n THEN b.near END AS form, CASE WHEN -b.less >= 2 * n THEN -b.less END AS form_n FROM v LEFT JOIN best USING (word)),
    follow AS (SELECT word, form AS root FROM told WHERE form IS NOT NULL UNION ALL SELECT follow.word, told.form FROM follow JOIN told ON root = told.word WHERE told.form IS NOT NULL),
    last AS (SELECT follow.word, root FROM follow JOIN told ON root = told.word WHERE told.form IS NULL)
    SELECT told.word, n, n_near, form, form_n, coalesce(root, told.word) AS root FROM told LEFT JOIN last USING (word)"""


def repairs() -> str:
    """op13: per row and state the least (cost, audit, repaired rows), with up to two inserts after each row."""
    # (state, letter, state after, cost, role that comes out; null: the row's own, '': none)
    moves = [(q, "D", q, 2, "") for q in range(4)] + [(q, "R", to, 1, role) for q, to, role in ((0, 2, "user"), (1, 2, "user"), (2, 3, "assistant"), (3, 2, "user"))]
    keeps = [(q, f"K{who}", to, 0, None) for q, who, to in ((0, "s", 1), (0, "u", 2), (1, "u", 2), (3, "u", 2), (2, "a", 3))]
    after = {0: ("user", "assistant"), 1: ("user", "assistant"), 2: ("assistant", "user"), 3: ("user", "assistant")}
    inserts = [(q, "I" * k, (q, *(2 if r == "user" else 3 for r in after[q]))[k], 5 * k, "".join(f"\\n{r}:" for r in after[q][:k])) for q in range(4) for k in range(3)]

    def values(rows: list[tuple]) -> str:
        shown = [", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"E'{x}'" for x in row) for row in rows]
        return "VALUES " + ", ".join(f"({x})" for x in shown)

    return rf"""WITH RECURSIVE own AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
    {checksums('own', 'key')},
    harmed AS (SELECT conv_id, turn, CASE WHEN h % 20 = 4 THEN 'user' ELSE role END AS role, CASE h % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM summed),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM harmed),
    coded AS (SELECT *, left(role, 1) AS who, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
      lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous, count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
    moves(q, letter, past, price, says) AS ({values(moves + keeps)}),
    inserts(q, letters, past, price, says) AS ({values(inserts)}),
    walk AS (SELECT conv_id, n, 0::BIGINT AS i, past AS q, struct_pack(cost := price, audit := letters, rows := says) AS b FROM (SELECT DISTINCT conv_id, n FROM coded) JOIN inserts ON q = 0
      UNION ALL
      SELECT w.conv_id, w.n, w.i + 1, inserts.past, min(struct_pack(cost := b.cost + moves.price + inserts.price + CASE WHEN fault = 'truncated' AND letter != 'D' THEN 5 ELSE 0 END, audit := b.audit || left(letter, 1) || letters,
        rows := b.rows || CASE WHEN letter = 'D' THEN '' ELSE chr(10) || coalesce(moves.says, role) || ':' || text END || inserts.says))
      FROM walk w JOIN coded c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND c.i = w.i + 1 JOIN moves ON moves.q = w.q AND (letter IN ('D', 'R') OR letter = 'K' || who) AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) JOIN inserts ON inserts.q = moves.past
      GROUP BY 1, 2, 3, 4),
    best AS (SELECT conv_id, min(b) AS b FROM walk WHERE i = n AND q IN (0, 3) GROUP BY 1),
    told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (i > 1 AND previous || who NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY 1)
    SELECT o.conv_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(substr(b.rows, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told ON o.conv_id IS NOT DISTINCT FROM told.conv_id LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id"""
