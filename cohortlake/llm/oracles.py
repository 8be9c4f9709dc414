"""SQL of the registered queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

#: White space of Java's and of Python's splitting into words (fixed values).
JAVA_SPACE = r"\t\n\x0B\f\r "
PYTHON_SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _components(nodes: str, links: str) -> str:
    """CTEs ``reach`` and ``component`` (node, component): all that a node reaches over links (a, b), both ways."""
    return f"""both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
    reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
    component AS (SELECT node, least(node, coalesce(min(b), node)) AS component FROM {nodes} LEFT JOIN reach ON a = node GROUP BY node)"""


def mixing(seed: int, entropy_share: float, block_tokens: int, block_rows: int, digits: int) -> str:
    """Bisection by recursion, then every block and document in its order, without the operator's shortcuts."""
    hashed = "CAST('0x' || substr(md5(concat_ws('|', {})), 1, " + str(digits) + ") AS BIGINT)"
    return rf"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{JAVA_SPACE}]+')) AS n_tokens, {hashed.format(f"'{seed}', CAST(doc_id AS VARCHAR), text")} AS key FROM documents
), totals AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS n, greatest(1, CAST(ceil(sum(n_tokens) / {block_tokens}) AS BIGINT), CAST(ceil(count(*) / {block_rows}) AS BIGINT)) AS n_blocks FROM counted GROUP BY source
), shares AS (
  SELECT *, CAST(n AS DOUBLE) / sum(n) OVER () AS p, {entropy_share} * ln(count(*) OVER ()) AS target FROM totals
), bisected AS (
  SELECT 0 AS k, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT k + 1, CASE WHEN met THEN middle ELSE low END, CASE WHEN met THEN high ELSE middle END FROM (
    SELECT k, low, high, (low + high) / 2 AS middle, ln(sum(pow(p, (low + high) / 2))) - sum(pow(p, (low + high) / 2) * (low + high) / 2 * ln(p)) / sum(pow(p, (low + high) / 2)) >= max(target) AS met
    FROM bisected, shares WHERE k < 60 AND p > 0 GROUP BY k, low, high)
), exponent AS (
  SELECT CASE WHEN (SELECT -sum(p * ln(p)) >= max(target) FROM shares WHERE p > 0) THEN 1 ELSE (SELECT low FROM bisected WHERE k = 60) END AS x
), epochs AS (
  SELECT source, n, n_blocks, CASE WHEN p > 0 THEN (sum(n) OVER ()) * (pow(p, x) / sum(CASE WHEN p > 0 THEN pow(p, x) ELSE 0 END) OVER ()) / n ELSE 0 END AS epochs FROM shares, exponent
), planned AS (
  SELECT source, n_blocks, CAST(floor(epochs + 1e-9) AS INTEGER) AS whole, CAST(round((epochs - floor(epochs + 1e-9)) * n) AS BIGINT) AS part FROM epochs
), placed AS (
  SELECT c.*, whole, part, c.key % n_blocks AS block FROM counted c JOIN planned p ON p.source IS NOT DISTINCT FROM c.source
), blocks AS (
  SELECT source, block, CAST(sum(n_tokens) AS BIGINT) AS n, {hashed.format(f"'{seed}', 'turn', CAST(block AS VARCHAR), source")} AS turn FROM placed GROUP BY source, block
), ordered AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY turn, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks
)
SELECT p.doc_id, p.source, p.n_tokens, p.block, CAST(whole + CASE
    WHEN part <= 0 OR before >= part THEN 0
    WHEN before + n <= part THEN 1
    WHEN sum(n_tokens) OVER (PARTITION BY p.source, p.block ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= part - before THEN 1
    ELSE 0 END AS INTEGER) AS copies
FROM placed p JOIN ordered o ON o.source IS NOT DISTINCT FROM p.source AND o.block = p.block
"""


def vector_links(threshold: float) -> str:
    """Cosines of all pairs, of vectors divided by their largest component, whose squares neither vanish nor overflow."""
    return f"""
WITH RECURSIVE usable AS (
  SELECT vec_id AS node, [CAST(x AS DOUBLE) / list_max([abs(CAST(y AS DOUBLE)) FOR y IN embedding]) FOR x IN embedding] AS v FROM embeddings
  WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT x.node AS a, y.node AS b FROM usable x JOIN usable y ON x.node < y.node AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= {threshold}
), nodes AS (SELECT DISTINCT vec_id AS node FROM embeddings), {_components("nodes", "links")},
linked AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component AS component_id, e.vec_id = component AS kept
FROM embeddings e JOIN component c ON c.node = e.vec_id LEFT JOIN linked l ON l.a = e.vec_id
"""


def near_documents(width: int, percent: int) -> str:
    """All pairs of documents that share a shingle."""
    return rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + least({width}, len(words)) - 1], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, len(words) - least({width}, len(words)) + 2)) AS i FROM split WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM shingles x JOIN shingles y ON y.shingle = x.shingle AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= {percent} * (x.n + y.n - m)
), nodes AS (SELECT DISTINCT doc_id AS node FROM documents), {_components("nodes", "links")}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, d.doc_id = component AS kept
FROM documents d JOIN component c ON c.node = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


def wordpiece_counts(begin: list[str], inside: list[str]) -> str:
    """Greedy longest match of each distinct word, a piece at a time; the vocabulary is part of the text."""

    def values(pieces: list[str], where: str) -> str:
        return ", ".join("('" + piece.replace("'", "''") + f"', {where})" for piece in dict.fromkeys(pieces))

    longest = max(map(len, [*begin, *inside]), default=0)
    return rf"""
WITH RECURSIVE pieces(piece, inner_piece) AS (VALUES {values(begin, "false")}, {values([p for p in inside if p], "true")}),
split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{PYTHON_SPACE}]+') AS words FROM documents),
listed AS (SELECT doc_id, unnest(words) AS word FROM split),
matched AS (
  SELECT DISTINCT word, 0 AS place, 0 AS n FROM listed
  UNION ALL
  SELECT m.word, m.place + max(length(piece)), m.n + 1 FROM matched m, range(0, {longest} + 1) l(size), pieces p
  WHERE (m.n = 0 OR m.place < length(m.word)) AND m.place + size <= length(m.word) AND p.piece = substr(m.word, m.place + 1, size) AND p.inner_piece = (m.n > 0)
  GROUP BY m.word, m.place, m.n
),
known AS (SELECT word, max(n) AS n FROM matched WHERE place = length(word) AND n > 0 GROUP BY word)
SELECT s.doc_id, any_value(len(s.words)) AS n_words, CAST(coalesce(sum(coalesce(k.n, 1)) FILTER (l.word IS NOT NULL), 0) AS BIGINT) AS n_tokens, count(*) FILTER (l.word IS NOT NULL AND k.word IS NULL) AS n_unknown
FROM split s LEFT JOIN listed l ON l.doc_id = s.doc_id LEFT JOIN known k ON k.word = l.word GROUP BY s.doc_id
"""


def collocations(least: int, inside_percent: int, top: int) -> str:
    """Phrases of 2 and 3 words, with each order counted on its own."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
), one AS (
  SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS i FROM words
), led AS (
  SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM one WINDOW p AS (PARTITION BY piece ORDER BY i)
), f AS (
  SELECT lang, 1 AS words, w1 AS phrase, count(*) AS f FROM led GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM led WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM led WHERE w3 IS NOT NULL GROUP BY ALL
), c AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE words > 1 AND f >= {least}
), cuts AS (
  SELECT lang, words, phrase, a, 1 AS k, p[1] AS x, array_to_string(p[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, words, phrase, a, 2, p[1] || ' ' || p[2], p[3] FROM c WHERE words = 3
), scored AS (
  SELECT cuts.*, fx.f AS l, fy.f AS r, CAST((1000000::HUGEINT * a * a) // (fx.f::HUGEINT * fy.f) AS BIGINT) AS score
  FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, p[1] || ' ' || p[2] AS phrase, a FROM c WHERE words = 3 UNION ALL SELECT lang, p[2] || ' ' || p[3], a FROM c WHERE words = 3
  ) GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
)
SELECT scored.lang, row_number() OVER (PARTITION BY scored.lang ORDER BY score DESC, a DESC, scored.phrase) AS rank, scored.phrase, a, l, r, n, score
FROM scored JOIN n ON n.lang = scored.lang LEFT JOIN longer ON longer.lang = scored.lang AND longer.phrase = scored.phrase
WHERE longer IS NULL OR 100 * longer < {inside_percent} * a
QUALIFY rank <= {top}
"""
