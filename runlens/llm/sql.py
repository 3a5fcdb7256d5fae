"""DuckDB SQL that states the results of the queries, where SQL can."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Checksum of the decimal id, bit by bit: -1 stands for a shift.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295)"""


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"):
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL = {
    "op1_chat_format": f"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), joined AS (
            SELECT conv_id, count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS spoken,
                coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
                sum(length('<|turn|><|text|><|end|>' || chr(10)) + length({_escaped("role")}) + length({_escaped("text")})) AS chars
            FROM said GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(learnt)::BIGINT AS loss_chars,
            sha256(learnt) AS loss_sha256, chars::BIGINT AS formatted_chars
        FROM joined""",
    "op3_ngram_join": f"""
        WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, translate(text, '{_UPPER}', '{_LOWER}') AS text FROM documents),
        worded AS (SELECT r, doc_id, {_WORDS} AS w FROM docs),
        sets AS (
            SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s
            FROM worded
        ), members AS (SELECT r, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (
            SELECT a.r AS a, b.r AS b FROM members a JOIN members b ON a.g = b.g AND a.r <> b.r
            GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach(a, b) AS (
            SELECT r, r FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        )
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM sets s JOIN (
            SELECT reach.a, min(t.doc_id) AS component_id FROM reach JOIN sets t ON t.r = reach.b GROUP BY reach.a
        ) c ON c.a = s.r""",
    "op5_token_counts": f"""
        WITH counted AS (
            SELECT source, lang, len({_WORDS})::BIGINT AS words,
                len(regexp_extract_all(coalesce(text, ''), '[a-z0-9]+|[^a-z0-9\\x20\\x09-\\x0D]'))::BIGINT AS pieces,
                lang IS NULL OR lang <> 'en' AS away
            FROM documents WHERE doc_id IS NOT NULL
        ), kept AS (
            SELECT source, lang, 'words-1' AS tokenizer, CASE WHEN away THEN pieces ELSE words END AS n FROM counted WHERE words >= 20
            UNION ALL SELECT source, lang, 'pieces-1', pieces FROM counted WHERE words >= 20 AND away
        )
        SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM kept GROUP BY ALL""",
    "op6_cover_tree": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op7_fair_mix": f"""
        WITH sizes AS (
            SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS shuffled FROM documents
        ), weighed AS (
            SELECT *, most / weight AS full_at FROM (
                SELECT source, sum(size)::BIGINT AS source_size, sum(size) * 2.0::DOUBLE AS most,
                    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
                FROM sizes GROUP BY source)
        ), leveled AS (
            SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER before, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM weighed WINDOW before AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), dealt AS (
            SELECT source, source_size,
                CASE WHEN l IS NULL OR full_at <= l THEN most ELSE weight * l END AS target
            FROM (SELECT *, (SELECT arg_min(level, full_at) FROM leveled WHERE level <= full_at) AS l FROM leveled)
        ), timed AS (
            SELECT doc_id, s.source, size, shuffled, source_size, target,
                sum(size) OVER (PARTITION BY s.source ORDER BY shuffled, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS words
            FROM sizes s JOIN dealt d ON s.source IS NOT DISTINCT FROM d.source
        ), queue AS (
            SELECT doc_id, size, source, shuffled, words, copy,
                sum(size) OVER (ORDER BY (words + copy * source_size) / target, source NULLS LAST, words, shuffled, copy, doc_id
                    ROWS UNBOUNDED PRECEDING) <= (SELECT sum(size) * 1.5::DOUBLE FROM sizes) AS fits
            FROM timed, (VALUES (0), (1)) c(copy) WHERE target > 0
        ), served AS (
            SELECT doc_id, size, source, shuffled, words, count(*) FILTER (WHERE fits) AS copies FROM queue GROUP BY ALL
        )
        SELECT t.doc_id, t.size, t.source_size, t.target, t.size * coalesce(v.copies, 0) AS taken
        FROM timed t LEFT JOIN served v ON t.doc_id IS NOT DISTINCT FROM v.doc_id AND t.size = v.size
            AND t.source IS NOT DISTINCT FROM v.source AND t.words = v.words""",
    "op9_line_dedup": f"""
        WITH docs AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        cut AS (
            SELECT n, doc_id, generate_subscripts(lines, 1) AS place, unnest(lines) AS line FROM docs
        ), keyed AS (
            SELECT *, translate(trim(line, {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM cut
        ), hot AS (
            SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT n) >= 10
        ), kept AS (
            SELECT n, any_value(doc_id) AS doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
                coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE h.key IS NULL), '') AS text
            FROM keyed k LEFT JOIN hot h ON k.key = h.key GROUP BY n
        )
        SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM kept""",
    "op10_quality_rules": f"""
        WITH docs AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
        words AS (
            SELECT n, doc_id, text, {_WORDS} AS words,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs
        ), grams AS (
            SELECT n, i, count(*) OVER (PARTITION BY n, g) > 1 AS twice FROM (
                SELECT n, unnest(range(1, len(words) - 6)) AS i, words[i : i + 7] AS g FROM words)
        ), covered AS (
            SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM grams, range(8) r(k) WHERE twice GROUP BY n
        ), features AS (
            SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines) AS n_lines,
                (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM words LEFT JOIN covered USING (n)
        ), judged AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM features
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
                OR n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines) AS kept
        FROM judged""",
    "op11_lexical_search": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, unnest({_TERMS}) AS term FROM documents
        ), counted AS (
            SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM docs GROUP BY r, term
        ), sized AS (
            SELECT r, sum(tf)::BIGINT AS size FROM counted GROUP BY r
        ), corpus AS (
            SELECT count(*) AS n_docs, sum(size)::BIGINT AS n_terms FROM sized
        ), items AS (
            SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark
        ), asked AS (
            SELECT i, item_id, term, count(*) AS c FROM items GROUP BY ALL
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM counted, corpus GROUP BY term, n_docs
        ), scored AS (
            SELECT i, item_id, r, doc_id,
                sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * size * n_docs) // n_terms))))::BIGINT AS score
            FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN sized USING (r), corpus GROUP BY i, item_id, r, doc_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op12_periodic_runs": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words, len({_WORDS})::BIGINT AS n, {_CRC32} AS h FROM documents
        ), cut AS (
            SELECT *, h // 10 % n AS a, 1 + (n - h // 10 % n) // (3 + h // 10 % 8) AS p FROM docs
        ), changed AS (
            SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                THEN list_transform(range(0, n), lambda i: words[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % p + 1 END]) ELSE words END AS words
            FROM cut
        ), placed AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(words) AS w FROM changed),
        equal AS (
            SELECT x.r, x.i, y.i - x.i AS q FROM placed x JOIN placed y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
        ), stretches AS (
            SELECT r, q, min(i) AS start, count(*) + q AS length FROM (
                SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal) GROUP BY r, q, island
        ), runs AS (
            SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length
        ), best AS (
            SELECT * FROM runs x WHERE NOT EXISTS (
                SELECT 1 FROM runs y WHERE x.r = y.r AND (y.length * x.period > x.length * y.period
                    OR y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period)))
        ), listed AS (
            SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
            FROM runs GROUP BY r
        ), kept AS (
            SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM placed p
            WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.r = p.r AND p.i >= x.start + x.period AND p.i < x.start + x.length) GROUP BY r
        )
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
            (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
            sha256(coalesce(text, '')) AS collapsed_sha256
        FROM changed LEFT JOIN best USING (r) LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)""",
    "op13_url_filter": f"""
        WITH rests AS (
            SELECT row_number() OVER () AS r, page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), parts AS (
            SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
        ), rules(rule_host, rule_path, says) AS (
            VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
        )
        SELECT any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path,
            arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
            coalesce(arg_max(says, length(rule_host || rule_path)), 'allow') AS verdict
        FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        GROUP BY r""",
}
