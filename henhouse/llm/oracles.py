"""DuckDB forms of the operators that SQL can state, written from their definitions."""

from __future__ import annotations

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = "[^\\x20\\x09-\\x0D]+"


def _run(n: int) -> str:
    """``n`` consecutive words of a document, null where fewer are left."""
    return " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER o" for k in range(1, n)]])


def _words(lowered: bool) -> str:
    text = f"translate(COALESCE(text, ''), {LETTERS})" if lowered else "COALESCE(text, '')"
    return f"""words AS (SELECT doc_id, regexp_extract_all({text}, '{WORDS}') AS w FROM documents),
each_word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words)"""


def repeats(n: int = 20) -> str:
    """op2: words covered by a window of ``n`` that also starts earlier."""
    return f"""WITH {_words(False)},
runs AS (SELECT doc_id, i, word, {_run(n)} AS run FROM each_word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
seen AS (SELECT doc_id, i, word, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS again FROM runs),
judged AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS gone FROM seen)
SELECT d.doc_id, count(j.i) AS n_words, count(j.i) FILTER (j.gone) AS n_removed,
       sha256(COALESCE(string_agg(j.word, ' ' ORDER BY j.i) FILTER (NOT j.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id"""


def near_copies(n: int, more: str = "") -> str:
    """op3 and op12: components of documents that share 80 % of their runs of ``n`` words."""
    return f"""WITH RECURSIVE {_words(True)},
runs AS (SELECT doc_id, {_run(n)} AS shingle FROM each_word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
each AS (SELECT DISTINCT doc_id, shingle FROM runs WHERE shingle IS NOT NULL
         UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND {n - 1}),
sized AS (SELECT d.doc_id, count(e.shingle) AS n FROM documents d LEFT JOIN each e ON e.doc_id = d.doc_id GROUP BY d.doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other)
SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id{more} FROM reached JOIN sized USING (doc_id) GROUP BY doc_id"""


# op13

def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*map(_field, ("doc_id", "source", "lang", "n_chars")), _field(text)]) + ")"


#: CRC-32 of the decimal doc_id, bit by bit.
_CRC = ("xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), "
        "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)")


def _tree(name: str, leaves: str) -> str:
    """The nodes of all levels, and what stands before and after each in its run."""
    return f"""{name}(tree, level, spot, node, n) AS (
  SELECT tree, 0, spot, node, n FROM {leaves}
  UNION ALL SELECT tree, level + 1, spot // 8, sha256(string_agg(node, '' ORDER BY spot)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY tree, level, spot // 8, n),
{name}_beside AS (
  SELECT a.tree, a.level, a.spot, COALESCE(string_agg(b.node, '' ORDER BY b.spot) FILTER (b.spot < a.spot), '') AS before,
         COALESCE(string_agg(b.node, '' ORDER BY b.spot) FILTER (b.spot > a.spot), '') AS after
  FROM {name} a JOIN {name} b ON b.tree = a.tree AND b.level = a.level AND b.spot // 8 = a.spot // 8 WHERE a.n > 1 GROUP BY ALL)"""


def _folded(name: str, start: str, beside: str) -> str:
    """Leaves folded upwards, with the siblings met on the way."""
    return f"""{name}(id, tree, level, spot, node, proof, changed) AS (
  SELECT id, tree, 0, spot, node, proof, changed FROM {start}
  UNION ALL SELECT f.id, f.tree, f.level + 1, f.spot // 8, sha256(s.before || f.node || s.after), f.proof || s.before || s.after,
         sha256(s.before || f.changed || s.after)
  FROM {name} f JOIN {beside} s ON s.tree = f.tree AND s.level = f.level AND s.spot = f.spot)"""


def manifest() -> str:
    lowered = _leaf(f"translate(text, {LETTERS})")
    return f"""WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS id, doc_id, COALESCE('1' || lang, '0') AS tree, {_leaf('text')} AS node,
         CASE WHEN {_CRC} % 3 = 0 THEN {lowered} ELSE {_leaf('text')} END AS changed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS spot, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_tree('langs', 'placed')},
subroots AS (SELECT tree AS lang, node, '' AS tree, row_number() OVER (ORDER BY encode(langs.tree)) - 1 AS spot, count(*) OVER () AS n FROM langs WHERE n = 1),
{_tree('top', 'subroots')},
root AS (SELECT node FROM top WHERE n = 1),
{_folded('inner_path', "(SELECT id, tree, spot, node, '' AS proof, changed FROM placed)", 'langs_beside')},
whole AS (SELECT * FROM inner_path QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1),
{_folded('outer_path', "(SELECT w.id, s.tree, s.spot, w.node, w.proof, w.changed FROM whole w JOIN subroots s ON s.lang = w.tree)", 'top_beside')},
done AS (SELECT * FROM outer_path QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)
SELECT p.doc_id, p.node AS leaf, s.node AS subroot, (SELECT node FROM root) AS root, sha256(d.proof) AS proof_sha256, d.changed AS folded_root,
       d.changed = (SELECT node FROM root) AS verified
FROM placed p JOIN done d ON d.id = p.id JOIN subroots s ON s.lang = p.tree"""
