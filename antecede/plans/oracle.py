"""The same results in plain SQL, one statement per query.

Statements share named subqueries: ``_sql`` puts those a statement needs in front of it.
"""

import re

from antecede.functions.numeric import EDGES13, EDGES9, POSITION_EDGES
from antecede.functions.stopwords import STOPWORDS
from antecede.operators.folds import SEED
from antecede.operators.joins import PRONOUN_GENDER
from antecede.operators.sequences import RESERVED

K = 5
CUT = 490
_PRON = r"\b(?:[Hh]e|[Ss]he|[Hh]im|[Hh]is|[Hh]er|[Hh]ers)\b"
_NAME = r"\b[A-Z][a-z]{2,}\b"
_TOK = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"
_MTOK = r"\[SEP\]|" + _TOK


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _bin(x: str, edges: list[int]) -> str:
    return f"CAST(len(list_filter({edges}, lambda e: e < {x})) AS INTEGER)"


def _onehot(x: str, edges: list[int]) -> str:
    last = len(edges) - 1
    return (
        f"array_to_string(list_transform(range({len(edges)}), "
        f"lambda i: CASE WHEN i = least({_bin(x, edges)}, {last}) THEN 1 ELSE 0 END), '')"
    )


def _fix6(x: str) -> str:
    return f"floor(({x}) * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e6 AS DOUBLE)"


def _hash32(key: str) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"


def _url_has(name: str) -> str:
    return f"contains(url, substr(replace(regexp_extract({name}, '\\S+'), '*', ''), 1, 1))"


def _clean(text: str) -> str:
    return f"replace(lower({text}), '#', '*')"


def _marked(text: str, tail: bool) -> str:
    clean = _clean(text)
    marked = f"regexp_replace({clean}, '([.!?])', '\\1 [SEP] ', 'g')"
    if tail:
        marked += f" || CASE WHEN regexp_matches({clean}, '[^.!?\\s]\\s*$') THEN ' [SEP]' ELSE '' END"
    return f"regexp_extract_all({marked}, '{_MTOK}')"


def _segments(order: str, markers: bool) -> str:
    points = (
        "[{'o': a_off, 'w': 0, 'l': length(a)}, {'o': b_off, 'w': 1, 'l': length(b)}, "
        "{'o': p_off, 'w': 2, 'l': length(pronoun)}]"
    )
    if order == "offset":
        points = f"list_sort({points})"
    piece = _marked if markers else (lambda t, tail: f"regexp_extract_all({_clean(t)}, '{_TOK}')")

    def cut(start: str, end: str) -> str:
        return f"substr(text, {start} + 1, greatest({end} - {start}, 0))"

    def off(i: int) -> str:
        return f"pts[{i}].o"

    def end(i: int) -> str:
        return f"(pts[{i}].o + pts[{i}].l)" if i else "0"

    tail_end = "length(text)" if order == "offset" else off(3)
    parts = []
    for i in (1, 2, 3):
        parts.append(f"{piece(cut(end(i - 1), off(i)), False)} AS c{i}")
        parts.append(f"regexp_extract_all({_clean(cut(off(i), end(i)))}, '{_TOK}') AS m{i}")
    parts.append(f"{piece(cut(end(3), tail_end), True)} AS tail")
    parts.append(f"regexp_extract_all(lower(string_split(url, '/')[-1]), '{_TOK}') AS title")
    starts = {1: "len(c1)", 2: "len(c1) + len(m1) + len(c2)"}
    starts[3] = f"{starts[2]} + len(m2) + len(c3)"
    url = f"{starts[3]} + len(m3) + len(tail)"

    def at(which: int, value) -> str:
        cases = " ".join(f"WHEN pts[{i}].w = {which} THEN {value(i)}" for i in (1, 2, 3))
        return f"CAST(CASE {cases} END AS INTEGER)"

    spans = []
    for which, s in enumerate("abp"):
        spans.append(f"{at(which, lambda i: starts[i])} AS {s}_start")
        spans.append(f"{at(which, lambda i: f'{starts[i]} + len(m{i}) - 1')} AS {s}_end")
    spans.append(f"CAST({url} AS INTEGER) AS url_start")
    spans.append(f"CAST({url} + len(title) - 1 AS INTEGER) AS url_end")
    return (
        f"SELECT id, c1 || m1 || c2 || m2 || c3 || m3 || tail || title AS tokens, {', '.join(spans)} "
        f"FROM (SELECT *, {', '.join(parts)} FROM (SELECT *, {points} AS pts FROM mentions_v))"
    )


_SPANS = ", ".join(f"{s}_{e}" for s in ("a", "b", "p", "url") for e in ("start", "end"))
_SPECIAL = ", ".join(f"('{t}', {i})" for t, i in RESERVED.items())
_FIRST_ID = max(RESERVED.values()) + 1
_VEC_ID = "CAST('0x' || substr(md5(token), 1, 6) AS BIGINT) % (SELECT count(*) FROM embeddings)"


def _ranked(rows: str, key: str) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS place FROM {rows}"


# Named subqueries, in an order in which each only uses earlier ones.
_VIEWS = {
    "docs": "SELECT doc_id AS id, text FROM documents",
    "english": "SELECT doc_id AS id, text FROM documents WHERE lang = 'en'",
    "m_pronoun": rf"""SELECT id, text, regexp_extract(text, '{_PRON}') AS pronoun,
        length(regexp_extract(text, '^([\s\S]*?){_PRON}', 1)) AS p_off
        FROM english WHERE regexp_matches(text, '{_PRON}')""",
    "m_left": """SELECT *, substr(text, 1, p_off) AS lft,
        CASE WHEN id % 2 = 0 THEN p_off + length(pronoun) ELSE 0 END AS shift FROM m_pronoun""",
    "m_a": rf"""SELECT *, regexp_extract(lft, '^[\s\S]*({_NAME})', 1) AS a,
        length(regexp_extract(lft, '^([\s\S]*){_NAME}', 1)) AS a_off
        FROM m_left WHERE regexp_matches(lft, '{_NAME}')""",
    "m_b": rf"""SELECT *, regexp_extract(substr(text, shift + 1), '{_NAME}') AS b,
        length(regexp_extract(substr(text, shift + 1), '^([\s\S]*?){_NAME}', 1)) + shift AS b_off
        FROM m_a WHERE regexp_matches(substr(text, shift + 1), '{_NAME}')""",
    "mentions_v": """SELECT id, text, pronoun, CAST(p_off AS INTEGER) AS p_off, a,
        CAST(a_off AS INTEGER) AS a_off, b, CAST(b_off AS INTEGER) AS b_off,
        target = 0 AS a_coref, target = 1 AS b_coref, url, CAST(target AS INTEGER) AS target
        FROM (SELECT *, CASE WHEN substr(md5(CAST(id AS VARCHAR)), 1, 1) < '5' THEN 0
                             WHEN substr(md5(CAST(id AS VARCHAR)), 1, 1) < 'a' THEN 1 ELSE 2 END AS target
              FROM m_b WHERE a_off <> b_off) m
        JOIN pages ON page_id = id % (SELECT count(*) FROM pages)""",
    "pieces": rf"""SELECT id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
        FROM (SELECT id, regexp_extract_all(text, '{_TOK}|\s+') AS p FROM docs)""",
    "placed": """SELECT id, i, piece,
        sum(length(piece)) OVER (PARTITION BY id ORDER BY i) - length(piece) AS start FROM pieces""",
    "toks": """SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS pos,
        CAST(start AS INTEGER) AS start, piece AS token,
        CAST(count(*) FILTER (piece IN ('.', '!', '?')) OVER (PARTITION BY id ORDER BY i
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS INTEGER) AS sent
        FROM placed WHERE trim(piece, chr(32) || chr(9) || chr(10) || chr(12) || chr(13)) <> ''""",
    "offsets": "SELECT id, unnest([{'s': 'p', 'o': p_off}, {'s': 'a', 'o': a_off}, {'s': 'b', 'o': b_off}], recursive := true) FROM mentions_v",
    "mtok_long": """SELECT id, s, CAST(greatest(0, least(count(*) FILTER (start <= o), count(*) - 1)) - 1
        AS INTEGER) AS tok FROM offsets JOIN toks USING (id) GROUP BY id, s""",
    "mtok": """SELECT id, max(tok) FILTER (s = 'p') AS p_tok, max(tok) FILTER (s = 'a') AS a_tok,
        max(tok) FILTER (s = 'b') AS b_tok FROM mtok_long GROUP BY id""",
    "dist": "SELECT id, p_tok, p_tok - a_tok AS dist_pa, p_tok - b_tok AS dist_pb FROM mtok",
    "sents": "SELECT id, sent, min(pos) AS first, count(*) AS len FROM toks GROUP BY id, sent",
    "mpos": """SELECT l.id, s, tok, k.sent, CAST(len AS INTEGER) AS len,
        CAST(CASE WHEN k.sent = 0 THEN tok + 1 ELSE tok - first END AS INTEGER) AS pos, first
        FROM mtok_long l JOIN toks k ON l.id = k.id AND greatest(l.tok, 0) = k.pos
        JOIN sents t ON l.id = t.id AND k.sent = t.sent""",
    "winpos": """SELECT *, CASE WHEN len <= 50 THEN first WHEN pos < 49 THEN first ELSE first + pos - 48 END AS lo,
        CASE WHEN len <= 50 THEN first + len WHEN pos < 49 THEN first + 50 ELSE first + least(pos + 2, len) END AS hi,
        CAST(CASE WHEN len <= 50 OR pos < 49 THEN pos ELSE 48 END AS INTEGER) AS win_pos FROM mpos""",
    "win_long": """SELECT w.id, s, win_pos, string_agg(token, ' ' ORDER BY k.pos) AS win
        FROM winpos w JOIN toks k ON w.id = k.id AND k.pos >= lo AND k.pos < hi GROUP BY w.id, s, win_pos""",
    "windows": "SELECT id, " + ", ".join(
        f"max(win) FILTER (s = '{s}') AS {s}_window, max(win_pos) FILTER (s = '{s}') AS {s}_window_pos"
        for s in "pab"
    ) + " FROM win_long GROUP BY id",
    "segs": _segments("offset", False),
    "segs_marked": _segments("offset", True),
    "segs_name": _segments("name", False),
    "sentences": r"""SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS sent, sentence
        FROM (SELECT id, i, regexp_replace(s, '^\s+|\s+$', '', 'g') AS sentence FROM
              (SELECT id, unnest(p) AS s, generate_subscripts(p, 1) AS i
               FROM (SELECT id, regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+') AS p FROM docs)))
        WHERE sentence <> ''""",
    "marked": """SELECT id, CASE WHEN n IS NULL THEN '' ELSE '[CLS] ' || body || ' [SEP]' ||
        CASE WHEN n = 1 THEN ' ' ELSE '' END END AS marked
        FROM docs LEFT JOIN (SELECT id, count(*) AS n, string_agg(sentence, ' [SEP] ' ORDER BY sent) AS body
        FROM sentences GROUP BY id) USING (id)""",
    "vocab": f"""SELECT token, CAST(token_id AS INTEGER) AS token_id FROM (VALUES {_SPECIAL}) v(token, token_id)
        UNION ALL SELECT token, CAST({_FIRST_ID - 1} + row_number() OVER (ORDER BY n DESC, token) AS INTEGER)
        FROM (SELECT token, count(*) AS n FROM
              (SELECT unnest(regexp_extract_all({_clean('text')}, '{_TOK}')) AS token FROM docs)
              GROUP BY token ORDER BY n DESC, token)""",
    "enc_long": """SELECT id, unnest(t) AS token, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos
        FROM (SELECT id, ['[CLS]'] || tokens AS t FROM segs_marked)""",
    "enc": f"""SELECT id, pos, coalesce(token_id, {RESERVED['[UNK]']}) AS token_id
        FROM enc_long LEFT JOIN vocab USING (token)""",
    "ids": "SELECT id, list(token_id ORDER BY pos) AS ids FROM enc GROUP BY id",
    "keyed": f"""SELECT id, sha256(array_to_string(ids, ',')) AS key, len(ids) AS n FROM ids""",
    "folded": f"""SELECT id, target, CAST(ntile({K}) OVER (PARTITION BY target
        ORDER BY md5('{SEED}|' || id), id) - 1 AS INTEGER) AS fold FROM mentions_v""",
    "shuffled": _ranked("mentions_v", f"md5('{SEED}|0|' || id), id"),
    "ordered": _ranked("mentions_v", "id"),
    "string_order": "SELECT CAST(id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(id AS VARCHAR)) - 1 AS place FROM mentions_v",
    "batched": """SELECT id, place // 32 AS batch_id, ids, max(len(ids)) OVER (PARTITION BY place // 32) AS longest
        FROM ids JOIN ordered USING (id)""",
    "padded": f"""SELECT *, longest AS width, false AS cut FROM batched
        UNION ALL SELECT *, least(longest, {CUT}) AS width, true AS cut FROM batched""",
    "rule": f"""SELECT id, id % 3 = 2 AS test, CAST(CASE WHEN abs(dist_pa) > {EDGES9[-1]} OR abs(dist_pb) > {EDGES9[-1]}
        OR abs(dist_pa) = abs(dist_pb) THEN 2 WHEN abs(dist_pa) < abs(dist_pb) THEN 0 ELSE 1 END AS INTEGER) AS target FROM dist""",
    "rule_fold": f"""SELECT *, CAST(ntile({K}) OVER (PARTITION BY target ORDER BY md5('{SEED}|' || id), id) - 1 AS INTEGER) AS fold FROM rule""",
    "prior": """SELECT id, CAST(CASE WHEN a_off = least(p_off, a_off, b_off) THEN 0.45 ELSE 0.4 END AS DOUBLE) AS pr_a,
        CAST(CASE WHEN b_off = least(p_off, a_off, b_off) THEN 0.3 ELSE 0.45 END AS DOUBLE) AS pr_b FROM mentions_v""",
    "probs": "SELECT id, pr_a, pr_b, CAST(1 AS DOUBLE) - (pr_a + pr_b) AS pr_neither FROM prior",
    "preds": f"""SELECT id, fold, target, CAST(f AS INTEGER) AS model_fold,
        pr_a + f / CAST(100 AS DOUBLE) AS pr_a, pr_b, pr_neither
        FROM probs JOIN folded USING (id), range({K}) r(f)""",
    "log": """SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS step,
        CAST(value AS DECIMAL(12,2)) AS loss, CAST(json_extract_string(props, '$.k') AS INTEGER) AS n FROM events""",
    "genders": "SELECT * FROM (VALUES " + ", ".join(
        f"('{p}', {g})" for p, g in PRONOUN_GENDER.items()
    ) + ") g(pron, gender)",
    "lex": """SELECT DISTINCT name, gender FROM (SELECT CASE WHEN a_coref THEN lower(a) WHEN b_coref THEN lower(b) END AS name,
        CAST(gender AS INTEGER) AS gender FROM mentions_v LEFT JOIN genders ON lower(pronoun) = pron) WHERE name IS NOT NULL""",
    "slots": """SELECT id, 'A' AS slot, lower(a) AS name FROM mentions_v
        UNION ALL SELECT id, 'B', lower(b) FROM mentions_v""",
    "slot_gender": """SELECT id, slot, name, gender FROM slots LEFT JOIN
        (SELECT name, min(gender) AS gender FROM lex GROUP BY name) USING (name)""",
    "pool": f"""SELECT gender, name AS replacement, row_number() OVER (PARTITION BY gender
        ORDER BY md5('{SEED}|' || name), name) - 1 AS pick, count(*) OVER (PARTITION BY gender) AS total FROM lex""",
    "swaps": f"""SELECT id, max(replacement) FILTER (slot = 'A') AS new_a, max(replacement) FILTER (slot = 'B') AS new_b
        FROM slot_gender s JOIN pool p ON s.gender = p.gender
        AND pick = {_hash32(f"'{SEED}|pick|' || id || '|' || slot")} % total
        WHERE {_hash32(f"'{SEED}|' || id || '|' || slot")} < 2147483648 GROUP BY id""",
    "swapped": """SELECT m.*, coalesce(new_a, a) AS na, coalesce(new_b, b) AS nb,
        length(coalesce(new_a, a)) - length(a) AS ga, length(coalesce(new_b, b)) - length(b) AS gb
        FROM mentions_v m LEFT JOIN swaps USING (id)""",
    "span_rows": "SELECT id, span, pos, token, " + _VEC_ID + """ AS vec_id FROM (""" + " UNION ALL ".join(
        f"""SELECT id, '{s.upper()}' AS span, unnest(range({s}_start, {s}_end + 1)) AS pos,
        unnest(tokens[{s}_start + 1 : {s}_end + 1]) AS token FROM segs""" for s in "abp"
    ) + ")",
    "span_dims": """SELECT id, span, pos, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
        CAST(unnest(embedding) AS DOUBLE) AS v FROM span_rows JOIN embeddings USING (vec_id)""",
    "pooled": """SELECT id, span, dim, CASE WHEN span = 'P' THEN sum(v ORDER BY pos)
        ELSE sum(v ORDER BY pos) / count(*) END AS v FROM span_dims GROUP BY id, span, dim""",
    "solid_tokens": r"""SELECT id, pos, token, length(translate(token, '# ', '')) AS len,
        sum(length(translate(token, '# ', ''))) OVER (PARTITION BY id ORDER BY pos) - length(translate(token, '# ', '')) AS c
        FROM toks""",
    "solid_starts": "SELECT id, pronoun, a, b, " + ", ".join(
        rf"length(regexp_replace(substr(text, 1, {s}_off), '[\s#]', '', 'g')) AS {s}_c" for s in "pab"
    ) + " FROM mentions_v",
    "aligned": "SELECT id, span, pos, token, " + _VEC_ID + r""" AS vec_id FROM (
        SELECT id, 'P' AS span, pos, token FROM solid_starts JOIN solid_tokens USING (id) WHERE len > 0 AND c = p_c
        UNION ALL SELECT id, 'A', pos, token FROM solid_starts JOIN solid_tokens USING (id)
            WHERE len > 0 AND c >= a_c AND c < a_c + length(regexp_replace(a, '[\s#]', '', 'g'))
        UNION ALL SELECT id, 'B', pos, token FROM solid_starts JOIN solid_tokens USING (id)
            WHERE len > 0 AND c >= b_c AND c < b_c + length(regexp_replace(b, '[\s#]', '', 'g')))""",
    "wide_rows": "SELECT id, span, pos, token, " + _VEC_ID + """ AS vec_id FROM (""" + " UNION ALL ".join(
        f"""SELECT id, '{s.upper()}' AS span, unnest(range({s}_start, least({s}_end + 2, len(tokens)))) AS pos,
        unnest(tokens[{s}_start + 1 : {s}_end + 2]) AS token FROM segs""" for s in "abp"
    ) + " UNION ALL SELECT id, 'URL', unnest(range(url_start, url_end + 1)), unnest(tokens[url_start + 1 : url_end + 1]) FROM segs)",
    "wide_scores": """SELECT id, span, pos, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]),
        (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM wide_rows JOIN embeddings USING (vec_id)""",
    "wide_weights": """SELECT *, exp(s - max(s) OVER (PARTITION BY id, span)) AS w FROM wide_scores""",
    "wide_dims": """SELECT id, span, pos, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
        CAST(unnest(embedding) AS DOUBLE) * share AS v FROM (SELECT *, w / sum(w) OVER (PARTITION BY id, span) AS share
        FROM wide_weights) JOIN embeddings USING (vec_id)""",
}


def _sql(body: str) -> str:
    """A statement with the views it needs, directly or through others."""
    needed, todo = set(), [body]
    while todo:
        part = todo.pop()
        for name, text in _VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", part):
                needed.add(name)
                todo.append(text)
    used = [f"{name} AS ({text})" for name, text in _VIEWS.items() if name in needed]
    return f"WITH {', '.join(used)} SELECT * FROM ({body})" if used else body


def _per_mention(body: str) -> str:
    return "SELECT id, " + ", ".join(body.replace("$", s) for s in "pab") + " FROM mpos GROUP BY id"


_PRIORS = "id, pr_a, pr_b, pr_neither"


def _half(s: str, t: str) -> str:
    """45 positional features of the pair (pronoun, name)."""
    parts = [
        _onehot(f"{t}.tok - p.tok", EDGES9),
        _onehot("p.pos", POSITION_EDGES),
        _onehot(f"{t}.pos", POSITION_EDGES),
        _onehot("p.len - p.pos", POSITION_EDGES),
        _onehot(f"{t}.len - {t}.pos", POSITION_EDGES),
    ]
    return " || ".join(parts) + f" AS features_{s}"


def _row_ids(source: str) -> str:
    return f"SELECT id, tokens_text AS tokens, {_SPANS} FROM (SELECT *, array_to_string(tokens, ' ') AS tokens_text FROM {source})"


def _range_row(column: str, kind: str) -> str:
    if kind in ("bigint", "int"):
        cases = " ".join(
            f"WHEN lo > -{2**b} AND hi < {2**b - 1} THEN '{t}'"
            for t, b in (("tinyint", 7), ("smallint", 15), ("int", 31))
        )
        choice = f"CASE {cases} ELSE '{kind}' END"
    else:
        choice = "CASE WHEN lo > -65504 AND hi < 65504 THEN 'float' ELSE 'double' END"
    added = f"CAST(sum({column}) AS BIGINT)" if kind in ("bigint", "int") else "CAST(NULL AS BIGINT)"
    return f"""SELECT '{column}' AS "column", '{kind}' AS from_type, CAST(lo AS DOUBLE) AS min_value,
        CAST(hi AS DOUBLE) AS max_value, {choice} AS to_type, cast_sum, {choice} AS cast_type
        FROM (SELECT min({column}) AS lo, max({column}) AS hi, {added} AS cast_sum FROM lineitem)"""


_MASK_A = f"{_hash32(f"'{SEED}|0|' || id || '|A'")} < 2147483648 AND pos BETWEEN a_start + 1 AND a_end + 1"
_MASK_B = f"{_hash32(f"'{SEED}|0|' || id || '|B'")} < 2147483648 AND pos BETWEEN b_start + 1 AND b_end + 1"

_TOKEN_SHAPE = "token"
for _pattern, _letter in (("[a-z]", "x"), ("[A-Z]", "X"), ("[0-9]", "d")):
    _TOKEN_SHAPE = f"regexp_replace({_TOKEN_SHAPE}, '{_pattern}', '{_letter}', 'g')"
for _letter in "xXd":
    _TOKEN_SHAPE = f"regexp_replace({_TOKEN_SHAPE}, '{_letter}{{5,}}', '{_letter * 4}', 'g')"

_MASK = "repeat('*', length(text))"
for _name, _off, _letter in (("pronoun", "p_off", "P"), ("a", "a_off", "A"), ("b", "b_off", "B")):
    _MASK = (
        f"(substr({_MASK}, 1, {_off}) || repeat('{_letter}', length({_name})) || "
        f"substr({_MASK}, {_off} + length({_name}) + 1))"
    )

_BODIES = {
    "scan_mentions": """SELECT CAST(id AS VARCHAR) AS id, text, pronoun, p_off, a, a_off, a_coref, b, b_off, b_coref, url
        FROM mentions_v""",
    "scan_template": "SELECT CAST(id AS VARCHAR) AS id, pr_a, pr_b, pr_neither FROM probs",
    "scan_names": "SELECT a AS name FROM mentions_v UNION SELECT b FROM mentions_v",
    "scan_token_vectors": f"""SELECT id, n_chars, pos, token, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
        {_fix6("CAST(unnest(embedding) AS DOUBLE)")} AS value FROM
        (SELECT id, CAST(length(text) AS INTEGER) AS n_chars, token, embedding,
         CAST(row_number() OVER (PARTITION BY id ORDER BY pos, span) - 1 AS INTEGER) AS pos
         FROM span_rows JOIN embeddings USING (vec_id) JOIN mentions_v USING (id))""",
    "write_folds": "SELECT id, target, fold FROM folded",
    "write_batches": f"""WITH runs AS (SELECT id, target, fold, CAST(f AS INTEGER) AS run_fold,
            CASE WHEN fold = f THEN 'valid' ELSE 'train' END AS split FROM folded, range({K}) r(f)),
        placed_rows AS (SELECT *, row_number() OVER (PARTITION BY run_fold, split ORDER BY
            CASE WHEN split = 'train' THEN md5('{SEED}|0|' || id) END, id) - 1 AS place FROM runs),
        sized AS (SELECT *, place // 32 AS batch_id, count(*) OVER (PARTITION BY run_fold, split, place // 32) AS size FROM placed_rows),
        kept AS (SELECT * FROM sized WHERE split = 'valid' OR size = 32),
        wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY run_fold, split, batch_id) AS width FROM kept JOIN ids USING (id))
        SELECT id, split, run_fold AS fold, batch_id, target, p_start + 1 AS p_start, url_end + 1 >= width AS truncated_span,
        array_to_string((ids || list_transform(range(width), lambda i: 0))[1:width], ',') AS ids FROM wide JOIN segs_marked USING (id)""",
    "write_predictions": "SELECT CAST(id AS VARCHAR) AS id, pr_a, pr_b, pr_neither FROM probs",
    "export_text": "SELECT CAST(id AS VARCHAR) AS row_key, text FROM mentions_v",
    "write_lexicon": "SELECT name, gender FROM lex",
    "project_rename": "SELECT id, pronoun, a AS a_noun, b AS b_noun, a_coref FROM mentions_v",
    "extract_target": "SELECT id, CASE WHEN target = 2 THEN 1 ELSE 0 END AS neither, target FROM mentions_v",
    "coref_label": "SELECT id, CASE target WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'Neither' END AS label FROM mentions_v",
    "extract_title": "SELECT page_id AS id, url, string_split(url, '/')[-1] AS title FROM pages",
    "normalise_text": f"SELECT id, {_clean('text')} AS text FROM docs",
    "mention_mask": f"SELECT id, {_MASK} AS mask FROM mentions_v",
    "mention_section": f"""SELECT id, lo AS section_min, p_end, a_end, b_end, hi AS section_max,
        substr(text, lo + 1, hi - lo) AS section_text, substr(mask, lo + 1, hi - lo) AS section_mask
        FROM (SELECT *, least(p_off, a_off, b_off) AS lo, greatest(p_end, a_end, b_end) AS hi FROM
        (SELECT *, {_MASK} AS mask, CAST(p_off + length(pronoun) AS INTEGER) AS p_end,
         CAST(a_off + length(a) AS INTEGER) AS a_end, CAST(b_off + length(b) AS INTEGER) AS b_end FROM mentions_v))""",
    "positional_prior": f"SELECT {_PRIORS} FROM probs",
    "token_table": f"""SELECT id, pos, token, {_TOKEN_SHAPE} AS shape, regexp_matches(token, '^[A-Za-z]+$') AS is_alpha,
        lower(token) IN ({_in(STOPWORDS)}) AS is_stop FROM toks""",
    "check_mentions": """SELECT id, 'P' AS mention, pronoun AS expected, substr(text, p_off + target + 1, length(pronoun)) AS found
        FROM mentions_v WHERE substr(text, p_off + target + 1, length(pronoun)) <> pronoun""",
    "check_single_token_pronoun": f"""SELECT id, p_start, p_end FROM ({_segments('offset', False).replace(
        'FROM mentions_v', "FROM (SELECT * REPLACE (substr(text, p_off + 1, length(a)) AS pronoun) FROM mentions_v)"
        )}) WHERE p_start <> p_end""",
    "check_template": """SELECT doc_id AS id, 'table' AS missing_from FROM labels WHERE doc_id NOT IN (SELECT id FROM mentions_v)
        UNION ALL SELECT id, 'template' FROM mentions_v WHERE id NOT IN (SELECT doc_id FROM labels)""",
    "marker_filter": "SELECT id FROM marked WHERE contains(marked, '#')",
    "word_tokens": "SELECT id, pos, start, token FROM toks",
    "sentence_split": f"SELECT id, sent, sentence, CAST(len(regexp_extract_all(sentence, '{_TOK}')) AS INTEGER) AS n_tokens FROM sentences",
    "char_to_token": "SELECT id, p_tok, a_tok, b_tok FROM mtok",
    "token_to_sentence": _per_mention("max(sent) FILTER (s = '$') AS $_sent"),
    "mention_distance": "SELECT id, dist_pa, dist_pb FROM dist",
    "distance_bin": f"SELECT id, {_bin('dist_pa', EDGES13)} AS d_pa, {_bin('dist_pb', EDGES13)} AS d_pb FROM dist",
    "distance_bin9": f"SELECT id, {_bin('dist_pa', EDGES9)} AS d_pa, {_bin('dist_pb', EDGES9)} AS d_pb FROM dist",
    "bucket_onehot": f"SELECT id, {_onehot('dist_pa', EDGES9)} AS hot_a, {_onehot('dist_pb', EDGES9)} AS hot_b FROM dist",
    "sentence_position": _per_mention(
        "max(sent) FILTER (s = '$') AS $_sent, max(len) FILTER (s = '$') AS $_len, max(pos) FILTER (s = '$') AS $_pos, "
        "max(len - pos) FILTER (s = '$') AS $_inv, "
        + _fix6("max(CAST(pos AS DOUBLE) / len) FILTER (s = '$')") + " AS $_ratio"
    ),
    "positional_features": f"""SELECT p.id, {_half('a', 'a')}, {_half('b', 'b')} FROM mpos p
        JOIN mpos a ON p.id = a.id AND a.s = 'a' JOIN mpos b ON p.id = b.id AND b.s = 'b' WHERE p.s = 'p'""",
    "mention_sentence_window": "SELECT * FROM windows",
    "url_contains": f"""SELECT id, CASE WHEN {_url_has('a')} THEN 1 ELSE 0 END AS a_in_url,
        CASE WHEN NOT {_url_has('a')} AND {_url_has('b')} THEN 1 ELSE 0 END AS b_in_url FROM mentions_v""",
    "url_contains3": f"""SELECT id, CASE WHEN {_url_has('a')} THEN 0 WHEN {_url_has('b')} THEN 1 ELSE 2 END AS in_url
        FROM mentions_v""",
    "distance_features": f"""SELECT id, string_split(url, '/')[-1] AS title, target,
        {_bin('dist_pa', EDGES13)} AS d_pa, {_bin('dist_pb', EDGES13)} AS d_pb,
        CASE WHEN {_url_has('a')} THEN 1 ELSE 0 END AS a_in_url,
        CASE WHEN NOT {_url_has('a')} AND {_url_has('b')} THEN 1 ELSE 0 END AS b_in_url FROM mentions_v JOIN dist USING (id)""",
    "mention_segments": _row_ids("segs"),
    "mention_segments_by_name": _row_ids("segs_name"),
    "mention_segments_marked": _row_ids("segs_marked"),
    "sentence_markers": "SELECT id, marked FROM marked",
    "nonspace_counts": "SELECT id, " + ", ".join(
        f"CAST(length(replace(substr(text, 1, {s}_off), ' ', '')) AS INTEGER) AS {s}_start, "
        f"CAST(length(replace({n}, ' ', '')) AS INTEGER) AS {s}_length"
        for s, n in (("p", "pronoun"), ("a", "a"), ("b", "b"))
    ) + " FROM mentions_v",
    "build_vocab": "SELECT token, token_id FROM vocab",
    "encode_tokens": "SELECT id, array_to_string(ids, ',') AS ids FROM ids",
    "batch_assign": """SELECT CAST(id AS VARCHAR) AS id, place // 32 AS batch_id, CAST(place % 32 AS INTEGER) AS batch_pos, 'train' AS mode
        FROM shuffled WHERE place // 32 < (SELECT count(*) // 32 FROM mentions_v)
        UNION ALL SELECT id, place // 32, CAST(place % 32 AS INTEGER), 'valid' FROM string_order""",
    "pad_truncate": f"""SELECT cut, id, batch_id, CAST(width AS INTEGER) AS width,
        array_to_string((ids || list_transform(range(width), lambda i: 0))[1:width], ',') AS ids,
        url_end + 1 >= width OR greatest(a_end, b_end, p_end) + 1 >= width AS truncated_span,
        {', '.join(f'{c.strip()} + 1 AS {c.strip()}' for c in _SPANS.split(','))} FROM padded JOIN segs_marked USING (id)""",
    "join_sentence_columns": """SELECT id, pronoun, a, b, p_window, p_window_pos, a_window_pos, b_window_pos
        FROM mentions_v LEFT JOIN windows USING (id)""",
    "pronoun_gender": "SELECT id, pronoun, CAST(gender AS INTEGER) AS gender FROM mentions_v LEFT JOIN genders ON lower(pronoun) = pron",
    "name_gender_lookup": "SELECT id, slot, name, gender FROM slot_gender",
    "attach_ids": f"SELECT {_PRIORS} FROM probs",
    "fold_expand": f"""SELECT id, fold, CAST(f AS INTEGER) AS run_fold, CASE WHEN fold = f THEN 'valid' ELSE 'train' END AS split
        FROM folded, range({K}) r(f)""",
    "encode_missing": """SELECT id, key, key IN (SELECT key FROM keyed WHERE id % 3 = 0) AS hit, n AS n_vectors FROM keyed""",
    "encode_missing_again": "SELECT id, key, true AS hit, n AS n_vectors, CAST(0 AS BIGINT) AS n_encoded FROM keyed",
    "padding_share": f"""WITH n AS (SELECT id, len(ids) AS n FROM ids), placed AS (
        SELECT 'by_id' AS mode, n, (row_number() OVER (ORDER BY id) - 1) // 32 AS b FROM n UNION ALL
        SELECT 'by_length', n, (row_number() OVER (ORDER BY n, md5('{SEED}|' || id), id) - 1) // 32 FROM n),
        wide AS (SELECT mode, n, max(n) OVER (PARTITION BY mode, b) AS width FROM placed)
        SELECT mode, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(width - n) AS BIGINT) AS n_padding,
        {_fix6('CAST(sum(width - n) AS DOUBLE) / sum(width)')} AS share FROM wide GROUP BY mode""",
    "length_batches": f"""WITH placed AS (SELECT id, ids, row_number() OVER (ORDER BY len(ids), md5('{SEED}|' || id), id) - 1 AS place FROM ids),
        wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY place // 32) AS width FROM placed)
        SELECT id, place // 32 AS batch_id, CAST(place % 32 AS INTEGER) AS batch_pos, CAST(width AS INTEGER) AS width,
        array_to_string((ids || list_transform(range(width), lambda i: 0))[1:width], ',') AS ids,
        url_end + 1 >= width OR greatest(a_end, b_end, p_end) + 1 >= width AS truncated_span,
        {', '.join(f'{c.strip()} + 1 AS {c.strip()}' for c in _SPANS.split(','))} FROM wide JOIN segs_marked USING (id)""",
    "encode_layers": """SELECT id, pos, token_id, CAST(8 AS INTEGER) AS n_values, CAST(token_id % 97 * 7 AS DOUBLE) AS v_first,
        CAST(token_id * 4 % 97 AS DOUBLE) AS v_last,
        CAST((token_id % 97 + token_id * 2 % 97 + token_id * 3 % 97 + token_id * 4 % 97) * 8 AS DOUBLE) AS v_all
        FROM enc WHERE token_id > 0""",
    "name_gender_lexicon": "SELECT name, gender FROM lex",
    "stratified_folds": "SELECT id, target, fold FROM folded",
    "stratified_folds_ordered": f"""SELECT id, target, CAST(ntile({K}) OVER (PARTITION BY target ORDER BY id) - 1 AS INTEGER) AS fold
        FROM mentions_v""",
    "union_splits": "SELECT id, pronoun, CAST(id % 3 AS INTEGER) AS source FROM mentions_v",
    "mask_span_augment": f"""SELECT id, string_agg(CAST(CASE WHEN {_MASK_B} THEN 2 WHEN {_MASK_A} THEN 1 ELSE token_id END AS VARCHAR), ',' ORDER BY pos) AS ids
        FROM enc JOIN segs_marked USING (id) GROUP BY id""",
    "name_swap_augment": """SELECT id, CASE WHEN a_off < b_off
        THEN substr(mid, 1, a_off) || na || substr(mid, a_off + length(a) + 1)
        ELSE substr(mid, 1, b_off) || nb || substr(mid, b_off + length(b) + 1) END AS text,
        CAST(p_off + CASE WHEN a_off < p_off THEN ga ELSE 0 END + CASE WHEN b_off < p_off THEN gb ELSE 0 END AS INTEGER) AS p_off,
        na AS a, CAST(a_off + CASE WHEN b_off < a_off THEN gb ELSE 0 END AS INTEGER) AS a_off,
        nb AS b, CAST(b_off + CASE WHEN a_off < b_off THEN ga ELSE 0 END AS INTEGER) AS b_off
        FROM (SELECT *, CASE WHEN a_off < b_off THEN substr(text, 1, b_off) || nb || substr(text, b_off + length(b) + 1)
              ELSE substr(text, 1, a_off) || na || substr(text, a_off + length(a) + 1) END AS mid FROM swapped)""",
    "target_counts": 'SELECT target, count(*) AS "count" FROM mentions_v GROUP BY target',
    "log_loss": f"""SELECT fold, count(*) AS n, {_fix6('sum(loss) / count(*)')} AS loss FROM
        (SELECT fold, -ln(CASE target WHEN 0 THEN pr_a WHEN 1 THEN pr_b ELSE pr_neither END / (pr_a + pr_b + pr_neither)) AS loss
         FROM preds WHERE model_fold = fold) GROUP BY ROLLUP (fold)""",
    "weighted_eval_loss": "SELECT run, CAST(sum(loss * n) AS DOUBLE) / nullif(CAST(sum(n) AS DOUBLE), 0) AS loss FROM log GROUP BY run",
    "fold_mean_ensemble": "SELECT id, " + ", ".join(
        f"{_fix6(f'avg({c})')} AS {c}" for c in ("pr_a", "pr_b", "pr_neither")
    ) + " FROM preds GROUP BY id",
    "topk_snapshot_ensemble": "SELECT run, id, " + ", ".join(
        f"{_fix6(f'avg({c})')} AS {c}" for c in ("pr_a", "pr_b", "pr_neither")
    ) + """ FROM (SELECT run, id, pr_a + CAST(loss AS DOUBLE) / 997 AS pr_a, pr_b, pr_neither,
        row_number() OVER (PARTITION BY id, run ORDER BY loss, step) AS place FROM
        (SELECT *, id % ((SELECT max(user_id) FROM events) + 1) AS run FROM probs) JOIN log USING (run))
        WHERE place <= 8 GROUP BY run, id""",
    "oof_assemble": "SELECT id, fold, pr_a, pr_b, pr_neither FROM preds WHERE model_fold = fold",
    "narrow_types": " UNION ALL ".join(
        _range_row(c, k)
        for c, k in (
            ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
            ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
        )
    ),
    "rolling_train_loss": """SELECT run, step, CAST(sum(loss * n) OVER w AS DOUBLE) / nullif(CAST(sum(n) OVER w AS DOUBLE), 0) AS train_loss
        FROM log WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)""",
    "best_snapshot": """SELECT run, step, CAST(loss AS DOUBLE) AS loss FROM log
        QUALIFY row_number() OVER (PARTITION BY run ORDER BY loss, step) = 1""",
    "early_stop_point": """WITH RECURSIVE walk AS (
        SELECT run, step, CAST(loss AS DOUBLE) AS best, step AS best_step, CAST(NULL AS INTEGER) AS stop FROM log WHERE step = 1
        UNION ALL SELECT w.run, l.step,
            CASE WHEN best > CAST(l.loss AS DOUBLE) + CAST(1e-4 AS DOUBLE) THEN CAST(l.loss AS DOUBLE) ELSE best END,
            CASE WHEN best > CAST(l.loss AS DOUBLE) + CAST(1e-4 AS DOUBLE) THEN l.step ELSE best_step END,
            CASE WHEN best > CAST(l.loss AS DOUBLE) + CAST(1e-4 AS DOUBLE) OR l.step - best_step <= 8 THEN NULL ELSE l.step END
        FROM walk w JOIN log l ON w.run = l.run AND l.step = w.step + 1 WHERE stop IS NULL)
        SELECT run, stop AS stop_step, best_step, best AS best_loss FROM walk
        QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) = 1""",
    "fit_scorer": "SELECT id, target, true AS clamped, true AS beats_chance FROM rule WHERE test",
    "save_load_scorer": "SELECT id, target, true AS same FROM rule WHERE test",
    "predict": "SELECT id, target, CAST(3 AS INTEGER) AS n_logits, true AS finite FROM rule WHERE test",
    "cross_validate": """SELECT 'valid' AS split, fold, count(*) AS n, true AS in_range FROM rule_fold WHERE NOT test GROUP BY ROLLUP (fold)
        UNION ALL SELECT 'test', NULL, count(*), true FROM rule WHERE test""",
    "evaluate_single_fold": "SELECT CAST(0 AS INTEGER) AS fold, count(*) AS n, true AS beats_chance FROM rule WHERE test",
    "span_mean_pool": f"""SELECT id, span, dim, {_fix6("CASE WHEN span = 'P' THEN sum(v ORDER BY pos) ELSE sum(v ORDER BY pos) / count(*) END")} AS value
        FROM (SELECT id, span, pos, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v
              FROM aligned JOIN embeddings USING (vec_id)) GROUP BY id, span, dim""",
    "encode_batches": f"""SELECT id, pos, token_id, CAST(embedding[1] AS DOUBLE) AS v_first, CAST(embedding[-1] AS DOUBLE) AS v_last,
        {_fix6("list_reduce(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i), lambda a, b: a + b)")} AS v_all
        FROM enc JOIN (SELECT token_id, {_VEC_ID} AS vec_id FROM vocab) USING (token_id) JOIN embeddings USING (vec_id)
        WHERE token_id > 0""",
    "select_layers": f"""SELECT id, span, CAST(pos AS INTEGER) AS pos, CAST(dim + shift AS INTEGER) AS dim, {_fix6('v * factor')} AS value
        FROM span_dims, (VALUES (0, 7), (64, 1)) f(shift, factor)""",
    "pronoun_vector": f"SELECT id, dim, {_fix6('v')} AS value FROM span_dims WHERE span = 'P'",
    "endpoint_span": f"""WITH ends AS (SELECT id, span, dim, arg_min(v, pos) AS x, arg_max(v, pos) AS y FROM span_dims
        WHERE span IN ('A', 'B') GROUP BY id, span, dim)
        SELECT id, span, dim, {_fix6('x')} AS value FROM ends
        UNION ALL SELECT id, span, CAST(dim + 64 AS INTEGER), {_fix6('y')} FROM ends
        UNION ALL SELECT id, span, CAST(dim + 128 AS INTEGER), {_fix6('x * y')} FROM ends""",
    "attentive_span": f"SELECT id, span, dim, {_fix6('sum(v ORDER BY pos)')} AS value FROM wide_dims GROUP BY id, span, dim",
    "pair_features": f"""WITH x AS (SELECT n.id, n.dim, n.v AS v, p.v AS p, CASE n.span WHEN 'A' THEN 0 ELSE 192 END AS shift
        FROM pooled n JOIN pooled p ON n.id = p.id AND n.dim = p.dim AND p.span = 'P' WHERE n.span <> 'P')
        SELECT id, CAST(shift + dim AS INTEGER) AS dim, {_fix6('v * p')} AS value FROM x
        UNION ALL SELECT id, CAST(shift + 64 + dim AS INTEGER), {_fix6('v')} FROM x
        UNION ALL SELECT id, CAST(shift + 128 + dim AS INTEGER), {_fix6('p')} FROM x""",
    "distance_embedding": f"""WITH b AS (SELECT id, 0 AS shift, {_bin('dist_pa', EDGES13)} AS bin FROM dist
        UNION ALL SELECT id, 4, {_bin('dist_pb', EDGES13)} FROM dist)
        SELECT id, CAST(shift + i AS INTEGER) AS dim, {_fix6('CAST(embedding[i + 1] AS DOUBLE)')} AS value
        FROM b JOIN embeddings ON vec_id = bin, range(4) r(i)""",
    "softmax_clamp": "WITH e AS (SELECT id, model_fold, "
    + ", ".join(f"exp({c} * 40 - greatest(pr_a, pr_b, pr_neither) * 40) AS {c}" for c in ("pr_a", "pr_b", "pr_neither"))
    + " FROM preds) SELECT id, model_fold, "
    + ", ".join(
        _fix6(f"greatest(least({c} / (pr_a + pr_b + pr_neither), CAST(0.9999 AS DOUBLE)), CAST(0.0001 AS DOUBLE))") + f" AS {c}"
        for c in ("pr_a", "pr_b", "pr_neither")
    )
    + " FROM e",
}


def all_sql() -> dict[str, str]:
    return {name: _sql(body) for name, body in _BODIES.items()}
