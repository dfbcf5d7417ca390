"""The queries that SQL can state, for DuckDB."""

from antecede.llm import licenses, sharding as shards

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> str:
    return (
        f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), "
        r"'[^\x20\x09-\x0D]+')"
    )


def shingles(w: str = "w", width: int = 5) -> str:
    """The word shingles of a list of words, as texts."""
    run = " || ' ' || ".join(f"{w}[i + {k}]" for k in range(width))
    return (
        f"CASE WHEN len({w}) >= {width} THEN list_transform(generate_series(1, len({w}) - {width - 1}), "
        f"lambda i: {run}) "
        f"WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END"
    )


def sharding(names: list[str], slots: int = shards.SLOTS) -> str:
    """Placement in SQL; the slots of the table are given, as tests check how it is filled."""
    numbers = ", ".join(map(str, shards.fill_table(names, slots)))
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""
WITH placed AS (
  SELECT doc_id, CAST(CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS BIGINT) % {slots} AS INTEGER) AS slot
  FROM documents
), filled AS (SELECT [{numbers}] AS shards, [{listed}] AS names)
SELECT doc_id, slot, shards[slot + 1] AS shard, names[shards[slot + 1] + 1] AS shard_name FROM placed, filled"""


def license_scan(notices: dict[str, str] = licenses.NOTICES) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in notices.items())
    plain = f"translate(coalesce(text, ''), {quote(licenses.FROM)}, {quote(licenses.TO)})"
    words_ = f"list_filter(regexp_extract_all({plain}, '[^\\x20\\x09-\\x0D]+'), lambda w: translate(w, {quote(licenses.MARKS)}, '') <> '')"
    five = " || ' ' || ".join(f"w[i + {k}]" for k in range(5))
    runs = f"unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: {five}) ELSE [] END)"
    return f"""
WITH split AS MATERIALIZED (SELECT doc_id, {words_} AS w FROM documents),
notice AS (
  SELECT DISTINCT license, {runs} AS s
  FROM (SELECT license, {words_} AS w FROM (VALUES {listed}) t(license, text))
), whole AS (SELECT license, count(*) AS n_notice FROM notice GROUP BY license),
near AS (SELECT DISTINCT a.license, b.license AS other FROM notice a JOIN notice b ON a.s = b.s AND a.license <> b.license),
apart AS (
  SELECT n.license, near.other, n.s FROM near JOIN notice n USING (license)
  WHERE NOT EXISTS (SELECT 1 FROM notice o WHERE o.license = near.other AND o.s = n.s)
), run AS (
  SELECT doc_id, {runs} AS s, {runs.replace(five, "i - 1")} AS word FROM split
), hit AS (SELECT doc_id, license, run.s, min(word) AS word FROM run JOIN notice ON run.s = notice.s GROUP BY doc_id, license, run.s),
found AS (
  SELECT doc_id, license, count(*) AS n_shared, min(word) AS first_word, n_notice
  FROM hit JOIN whole USING (license) GROUP BY doc_id, license, n_notice HAVING 5 * count(*) >= 4 * n_notice
), told AS (
  SELECT f.doc_id, f.license, a.other, count(*) AS n, count(h.s) AS n_held
  FROM found f JOIN apart a ON a.license = f.license
  LEFT JOIN hit h ON h.doc_id = f.doc_id AND h.license = a.license AND h.s = a.s GROUP BY f.doc_id, f.license, a.other
)
SELECT doc_id, license, n_shared, n_notice, first_word FROM found f
WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.doc_id = f.doc_id AND t.license = f.license AND 5 * n_held < 4 * n)"""


def decontamination() -> str:
    return f"""
WITH item AS (SELECT item_id, {words()} AS w FROM benchmark WHERE item_id IS NOT NULL),
item_shingle AS (SELECT DISTINCT item_id, unnest({shingles()}) AS s FROM item),
item_size AS (SELECT item_id, count(*) AS n_item FROM item_shingle GROUP BY item_id),
doc AS (SELECT doc_id, {words()} AS w FROM documents),
doc_shingle AS (SELECT DISTINCT doc_id, unnest({shingles()}) AS s FROM doc),
shared AS (
  SELECT doc_id, item_id, count(*) AS n_shared
  FROM doc_shingle JOIN item_shingle USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shared, n_item
FROM shared JOIN item_size USING (item_id) WHERE 5 * n_shared >= 4 * n_item"""


def line_dedup() -> str:
    return r"""
WITH line AS (
  SELECT doc_id, text, i, ls[i] AS x
  FROM (SELECT doc_id, text, ls, unnest(generate_series(1, len(ls))) AS i
        FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents))
), three AS (
  SELECT doc_id, i AS first, lead(i, 2) OVER d AS last,
         x AS x1, lead(x) OVER d AS x2, lead(x, 2) OVER d AS x3
  FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT doc_id, first, last FROM (
    SELECT *, row_number() OVER (PARTITION BY x1, x2, x3 ORDER BY doc_id, first) AS k
    FROM three WHERE last IS NOT NULL)
  WHERE k > 1
), gone AS (SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS i FROM later),
kept AS (
  SELECT line.doc_id, count(gone.i) AS n_removed,
         coalesce(string_agg(x, chr(10) ORDER BY line.i) FILTER (WHERE gone.i IS NULL), '') AS text
  FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.i = gone.i GROUP BY line.doc_id
)
SELECT documents.doc_id, kept.text, coalesce(n_removed, 0) AS n_removed
FROM documents LEFT JOIN kept USING (doc_id)"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text: a fold over its characters, eight bits each."""
    bit = "lambda s, z: xor(s >> 1, 3988292384 * (s & 1))"
    byte = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {byte}), 4294967295)"


def merkle_manifest() -> str:
    field = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    leaf = lambda n: "sha256(" + " || ".join(map(field, ["doc_id", "source", "lang", n, "text"])) + ")"
    changed = f"CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {leaf('(n_chars + 1)')} ELSE leaf END"

    def tree(name: str, leaves: str) -> str:
        return f"""{name} AS (
  {leaves}
  UNION ALL
  SELECT grp, level + 1, pos // 2, (total + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE total > 1 GROUP BY grp, level, pos // 2, total
)"""

    def way(nodes: str, grp: str) -> str:
        """Sibling of the node at each level, behind the side it is on, for a leaf at ``pos``."""
        return f"""SELECT {grp}, n.level, CASE WHEN s.digest IS NULL THEN '-' WHEN s.pos < n.pos THEN 'L' || s.digest ELSE 'R' || s.digest END AS step
  FROM ({nodes}) n LEFT JOIN"""

    return f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, n_chars, source, text, {leaf("n_chars")} AS leaf FROM documents
), placed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, leaf, {changed} AS changed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS total
  FROM hashed
),
{tree("docs", "SELECT grp, 0 AS level, pos, total, leaf AS digest FROM placed")},
subroots AS (
  SELECT grp AS name, digest, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS total
  FROM docs WHERE total = 1
),
{tree("langs", "SELECT '' AS grp, 0 AS level, pos, total, digest FROM subroots")},
steps AS (
  {way("SELECT p.grp, p.pos AS leaf_pos, level, p.pos >> level AS pos FROM placed p JOIN (SELECT DISTINCT grp, level FROM docs WHERE total > 1) USING (grp)", "n.grp, n.leaf_pos, 0 AS part")}
  docs s ON s.grp = n.grp AND s.level = n.level AND s.pos = xor(n.pos, 1)
), over AS (
  {way("SELECT name, level, p.pos >> level AS pos FROM subroots p, (SELECT DISTINCT level FROM langs WHERE total > 1)", "n.name")}
  langs s ON s.level = n.level AND s.pos = xor(n.pos, 1)
), whole AS (
  SELECT grp, leaf_pos, part, level, step FROM steps
  UNION ALL SELECT p.grp, p.pos, 1, o.level, o.step FROM placed p JOIN over o ON o.name = p.grp
), ways AS (
  SELECT grp, leaf_pos AS pos, list(step ORDER BY part, level) AS way FROM whole GROUP BY grp, leaf_pos
), result AS (
  SELECT doc_id, leaf, changed, subroots.digest AS subroot, (SELECT digest FROM langs WHERE total = 1) AS root,
         coalesce(way, []) AS way
  FROM placed JOIN subroots ON subroots.name = placed.grp LEFT JOIN ways ON ways.grp = placed.grp AND ways.pos = placed.pos
), folded AS (
  SELECT *, list_reduce(list_prepend(changed, way), lambda a, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || a) WHEN 'R' THEN sha256(a || s[2:]) ELSE sha256(a) END) AS folded_root
  FROM result
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: s[2:]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded"""


def html_extraction() -> str:
    """The layout of the driver's pages in SQL: what stands in their ``article``, which wrappers have to find."""
    inside = r"regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1)"
    blocks = rf"regexp_replace(regexp_replace({inside}, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g')"
    decoded = rf"regexp_replace(replace({blocks}, '&quot;', chr(34)), '&amp;?', '&', 'g')"
    return rf"""
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars
FROM (SELECT page_id, url, trim(regexp_replace({decoded}, '\s+', ' ', 'g')) AS text FROM pages)"""
