"""SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations


def _merkle_sql(levels: int = 5, source_levels: int = 3) -> str:
    """Trees of at most 16**levels leaves per source and 16**source_levels sources, level by level.

    crc32 is worked out bit by bit: -1 stands for a shift, other numbers for bytes.
    """

    def climb(name: str, first: str, key: str, height: int) -> str:
        """{name}{k}: (key, place, node, size) of level k; a level of one node is handed on as it is."""
        made = [f"{name}0 AS ({first})"]
        for k in range(height):
            made.append(f"""
                {name}{k + 1} AS (
                    SELECT {key}, place // 16 AS place, max(size) AS below,
                           CASE WHEN max(size) = 1 THEN max(node) ELSE sha256(string_agg(node, '' ORDER BY place)) END AS node,
                           (max(size) + 15) // 16 AS size
                    FROM {name}{k} GROUP BY {key}, place // 16)""")
        return ",".join(made)

    def field(column: str) -> str:
        return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen({column}::VARCHAR) || ':' || {column}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def siblings(name: str, key: str, at: str, height: int) -> str:
        """Per row of {at}: node texts before and after its own at each level, null where nothing rises."""
        made = []
        for k in range(height):
            made.append(f"""
                {name}_s{k} AS (
                    SELECT a.{key}, a.place, any_value(n.size) > 1 AS rises,
                           coalesce(string_agg(n.node, '' ORDER BY n.place) FILTER (n.place < a.place), '') AS l,
                           coalesce(string_agg(n.node, '' ORDER BY n.place) FILTER (n.place > a.place), '') AS r
                    FROM {name}{k} a JOIN {name}{k} n ON n.{key} = a.{key} AND n.place // 16 = a.place // 16
                    GROUP BY a.{key}, a.place)""")
        return ",".join(made)

    steps = [("t", k, f"d.place // {16**k}", "d.tree") for k in range(levels)]
    steps += [("u", k, f"c.place // {16**k}", "0") for k in range(source_levels)]
    joins = "".join(
        f" JOIN {n}_s{k} AS {n}{k}s ON {n}{k}s.{'tree' if n == 't' else 'top'} = {key} AND {n}{k}s.place = {place}"
        for n, k, place, key in steps
    )
    proof = " || ".join(f"CASE WHEN {n}{k}s.rises THEN {n}{k}s.l || {n}{k}s.r ELSE '' END" for n, k, _, _ in steps)
    folds, before = [], "met"
    for n, k, _, _ in steps:
        folds.append(f"""
            f_{n}{k} AS (SELECT * REPLACE (CASE WHEN {n}{k}_rises THEN sha256({n}{k}_l || folded || {n}{k}_r) ELSE folded END AS folded) FROM {before})""")
        before = f"f_{n}{k}"
    columns = ", ".join(f"{n}{k}s.{c} AS {n}{k}_{c}" for n, k, _, _ in steps for c in ("rises", "l", "r"))
    return f"""
        WITH marked AS (
            SELECT *, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree,
                   xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                           lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda a, x: CASE WHEN x < 0 THEN xor(a >> 1, (a & 1) * 3988292384) ELSE xor(a, x) END), 4294967295) AS crc
            FROM documents
        ),
        digested AS (
            SELECT doc_id, tree, {leaf("text")} AS leaf,
                   CASE WHEN crc % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
            FROM marked
        ),
        d AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM digested),
        {climb("t", "SELECT tree, place, leaf AS node, count(*) OVER (PARTITION BY tree) AS size FROM d", "tree", levels)},
        {siblings("t", "tree", "t", levels)},
        c AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM t{levels}),
        {climb("u", "SELECT 0 AS top, place, subroot AS node, count(*) OVER () AS size FROM c", "top", source_levels)},
        {siblings("u", "top", "u", source_levels)},
        met AS (
            SELECT d.doc_id, d.leaf, c.subroot, (SELECT max(node) FROM u{source_levels}) AS root,
                   sha256({proof}) AS proof_sha256, coalesce(d.tampered, d.leaf) AS folded, {columns}
            FROM d JOIN c USING (tree){joins}
        ),
        {",".join(folds)}
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified FROM {before}
    """


ORACLES = {
    "op2_quality": r"""
        WITH whole AS (
            SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ),
        windows AS (
            SELECT doc_id, k, words[k] AS a, words[k + 1] AS b, words[k + 2] AS c
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS k FROM whole)
        ),
        again AS (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times FROM windows),
        covered AS (
            SELECT doc_id, count(DISTINCT place) AS n FROM (
                SELECT doc_id, unnest([k, k + 1, k + 2]) AS place FROM again WHERE times > 1) GROUP BY 1
        ),
        counts AS (
            SELECT doc_id, lang, source, len(words) AS n_words,
                   length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                   coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines,
                   length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
            FROM whole LEFT JOIN covered USING (doc_id)
        ),
        failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
        parts AS (
            SELECT *, unnest([
                {'ratio': 'word_length', 'part': word_chars, 'whole': n_words, 'slack': 500},
                {'ratio': 'symbols', 'part': n_symbols, 'whole': n_words, 'slack': 50},
                {'ratio': 'dup_lines', 'part': n_dup_lines, 'whole': n_lines, 'slack': 100},
                {'ratio': 'repeats', 'part': n_repeat_words, 'whole': n_words, 'slack': 50},
                {'ratio': 'upper', 'part': n_upper, 'whole': word_chars, 'slack': 50}]) AS r
            FROM failed
        ),
        ratios AS (
            SELECT doc_id, lang, source, base_failed, r.ratio AS ratio, r.slack AS slack,
                   CASE WHEN r.whole > 0 THEN r.part * 1000 // r.whole ELSE 0 END AS v FROM parts
        ),
        sketch AS (
            SELECT lang, source, ratio, v >> greatest(length(bin(v)) - 6, 0) << greatest(length(bin(v)) - 6, 0) AS bucket,
                   count(*) AS n
            FROM ratios WHERE NOT base_failed GROUP BY ALL
        ),
        merged AS (
            SELECT 1 AS level, lang, source, ratio, bucket, n FROM sketch
            UNION ALL SELECT 2, lang, '', ratio, bucket, n FROM sketch
            UNION ALL SELECT 3, '', '', ratio, bucket, n FROM sketch
        ),
        summed AS (SELECT level, lang, source, ratio, bucket, sum(n) AS n FROM merged GROUP BY ALL),
        placed AS (
            SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS upto,
                   sum(n) OVER (PARTITION BY level, lang, source, ratio) AS size FROM summed
        ),
        quartiles AS (
            SELECT level, lang, source, ratio, max(size) AS size,
                   [min(bucket) FILTER (upto * 100 >= size * 25), min(bucket) FILTER (upto * 100 >= size * 50),
                    min(bucket) FILTER (upto * 100 >= size * 75)] AS q
            FROM placed GROUP BY ALL
        ),
        chosen AS (
            SELECT r.*, CASE WHEN own.size >= 200 THEN own.q WHEN of_lang.size >= 200 THEN of_lang.q ELSE of_all.q END AS q
            FROM ratios r
            JOIN quartiles own ON own.level = 1 AND own.lang = r.lang AND own.source = r.source AND own.ratio = r.ratio
            JOIN quartiles of_lang ON of_lang.level = 2 AND of_lang.lang = r.lang AND of_lang.ratio = r.ratio
            JOIN quartiles of_all ON of_all.level = 3 AND of_all.ratio = r.ratio
        ),
        judged AS (
            SELECT doc_id, bool_and(v <= q[3] + 3 * greatest(q[3] - q[2], slack)
                                    AND (ratio <> 'word_length' OR v >= q[1] - 3 * greatest(q[2] - q[1], slack))) AS inside
            FROM chosen GROUP BY 1
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, base_failed,
               NOT base_failed AND coalesce(inside, false) AS kept
        FROM failed LEFT JOIN judged USING (doc_id)
    """,
    "op3_chat": """
        WITH RECURSIVE calls AS (
            SELECT conv_id, turn, conv_id || '-' || turn AS call_id, text,
                   CASE WHEN turn >= 2 THEN conv_id || '-' || (turn // 4 * 2 + turn % 2) END AS needs
            FROM conversations WHERE role = 'user'
        ),
        levels AS (
            SELECT call_id, 0 AS level FROM calls WHERE needs IS NULL
            UNION ALL
            SELECT c.call_id, l.level + 1 FROM calls c JOIN levels l ON c.needs = l.call_id
        ),
        answers AS (
            SELECT conv_id || '-' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant'
        )
        SELECT c.conv_id, c.turn, c.call_id, 'ask' AS name, l.level, length(c.text) <= 1000 AS valid,
               CASE WHEN a.call_id IS NULL THEN 0 ELSE 1 END AS results,
               '{' || CASE WHEN length(c.text) <= 1000 THEN '"arguments":'
                   || to_json('{"length":' || length(c.text) || ',"text":' || to_json(c.text) || ',"turn":' || c.turn || '}') || ',' ELSE '' END
                   || '"id":' || to_json(c.call_id) || ',"name":"ask"'
                   || CASE WHEN a.content IS NULL THEN '' ELSE ',"result":' || to_json(a.content) END || '}' AS line
        FROM calls c LEFT JOIN levels l USING (call_id) LEFT JOIN answers a USING (call_id)
    """,
    "op5_minhash": r"""
        WITH RECURSIVE whole AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ),
        shingles AS (
            SELECT DISTINCT doc_id, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] AS s
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS k FROM whole)
            UNION ALL
            SELECT doc_id, array_to_string(words, ' ') FROM whole WHERE len(words) IN (1, 2)
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
            FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
        ),
        links AS (
            SELECT a, b FROM shared JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
            WHERE 100 * shared.n >= 85 * (sa.n + sb.n - shared.n)
        ),
        steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached AS (
            SELECT doc_id, doc_id AS other FROM whole
            UNION
            SELECT r.doc_id, s.b FROM reached r JOIN steps s ON s.a = r.other
        ),
        found AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY 1)
        SELECT doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM found LEFT JOIN sizes USING (doc_id)
    """,
    "op7_exact": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY sha256(coalesce(text, '')))
    """,
    "op12_negatives": """
        WITH clean AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, list_inner_product(a.v, x.v)::BIGINT AS score
            FROM clean a JOIN clean x ON a.vec_id <> x.vec_id AND len(a.v) = len(x.v)
            WHERE a.vec_id % 100 = 0
        ),
        positives AS (
            SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
        )
        SELECT anchor_id, positive_id,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
    """,
    "op13_merkle": _merkle_sql(),
}
