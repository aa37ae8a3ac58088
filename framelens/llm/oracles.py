"""SQL texts, for DuckDB, of the queries of this folder that SQL can express."""

# Unsigned crc32 of a text of ASCII characters, bit by bit.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''),
  lambda c: list_transform(range(8), lambda i: ((ascii(c) >> i::INTEGER) & 1)::BIGINT)))),
  lambda a, b: CASE WHEN (xor(a, b) & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_PARENTS = "list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))"

OP11 = f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, leaf, tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
               CASE WHEN {CRC32.format('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('(n_chars::HUGEINT + 1)')} END AS tampered FROM documents)),
levels AS (
  SELECT lang, 0 AS l, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY lang
  UNION ALL SELECT lang, l + 1, {_PARENTS} FROM levels WHERE len(nodes) > 1),
nodes AS (SELECT lang, l, unnest(nodes) AS h, unnest(range(len(nodes))) AS i, len(nodes) AS n FROM levels),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM nodes WHERE n = 1),
toplevels AS (
  SELECT 0 AS l, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL SELECT l + 1, {_PARENTS} FROM toplevels WHERE len(nodes) > 1),
topnodes AS (SELECT l, unnest(nodes) AS h, unnest(range(len(nodes))) AS i, len(nodes) AS n FROM toplevels),
heights AS (SELECT DISTINCT lang, l FROM nodes WHERE n > 1),
topheights AS (SELECT DISTINCT l FROM topnodes WHERE n > 1),
steps AS (
  SELECT f.lang, f.pos, h.l, (f.pos >> h.l) & 1 AS side, s.h AS sibling
  FROM leaves f JOIN heights h ON f.lang IS NOT DISTINCT FROM h.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM f.lang AND s.l = h.l AND s.i = xor(f.pos >> h.l, 1)
  UNION ALL
  SELECT f.lang, f.pos, 1000 + h.l, (r.place >> h.l) & 1, s.h
  FROM leaves f JOIN subroots r ON f.lang IS NOT DISTINCT FROM r.lang CROSS JOIN topheights h
  LEFT JOIN topnodes s ON s.l = h.l AND s.i = xor(r.place >> h.l, 1)),
proofs AS (
  SELECT lang, pos, coalesce(string_agg(sibling, '' ORDER BY l), '') AS siblings,
         list(CASE WHEN sibling IS NULL THEN '' WHEN side = 1 THEN 'L' || sibling ELSE 'R' || sibling END ORDER BY l) AS steps
  FROM steps GROUP BY lang, pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (
  SELECT f.doc_id, f.leaf, r.subroot, t.h AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
         list_reduce(list_concat([coalesce(f.tampered, f.leaf)], coalesce(p.steps, [])), lambda a, s: CASE WHEN s = '' THEN sha256(a)
           WHEN s[1] = 'L' THEN sha256(s[2:] || a) ELSE sha256(a || s[2:]) END) AS folded_root
  FROM leaves f JOIN subroots r ON f.lang IS NOT DISTINCT FROM r.lang CROSS JOIN (SELECT h FROM topnodes WHERE n = 1) t
  LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM f.lang AND p.pos = f.pos)"""

OP8 = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[s:s + 3] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes m ON m.doc_id = x JOIN sizes n ON n.doc_id = y WHERE 100 * o >= 85 * (m.n + n.n - o)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) r ON r.x = d.doc_id"""
