"""SQL for DuckDB of the queries that SQL can express.

Fingerprints (XXH64), token ids and the conditional random field have no SQL; tests/llm holds them against brute force.
"""

from __future__ import annotations

from adtally.llm import quality_rules, sharding
from adtally.llm.quality_rules import RULES, Rule

_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_WORD}')"

_SUBSTRING_DEDUP = f"""
WITH given AS (SELECT doc_id, {_WORDS} AS words FROM documents),
numbered AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM given),
windows AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER w AS seen, count(*) OVER w AS n FROM numbered
    WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
later AS (SELECT doc_id, i FROM windows WHERE n = 20
    QUALIFY row_number() OVER (PARTITION BY seen ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
kept AS (SELECT n.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
    string_agg(word, ' ' ORDER BY n.i) FILTER (g.i IS NULL) AS rest
    FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i GROUP BY n.doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(rest, '')) AS kept_sha256 FROM given LEFT JOIN kept USING (doc_id)"""

_SOURCE_MIXING = f"""
WITH RECURSIVE sized AS (SELECT doc_id, source, len({_WORDS}) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS shuffle FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM sized GROUP BY source),
filled AS (
    SELECT 0 AS turn, 1.5 * sum(source_size) AS budget, sum(weight) AS open_weight, CAST([] AS VARCHAR[]) AS full_ones,
        CAST(NULL AS DOUBLE) AS level FROM sources
    UNION ALL
    SELECT turn + 1, f.budget - coalesce(x.most, 0), f.open_weight - coalesce(x.weight, 0), list_concat(full_ones, coalesce(x.names, [])),
        CASE WHEN x.names IS NULL THEN f.budget / f.open_weight END
    FROM (SELECT * FROM filled WHERE level IS NULL AND open_weight > 0) f LEFT JOIN LATERAL (
        SELECT list(coalesce('=' || source, '')) AS names, 2 * sum(source_size) AS most, sum(weight) AS weight FROM sources
        WHERE NOT list_contains(f.full_ones, coalesce('=' || source, ''))
            AND f.budget * weight / f.open_weight >= 2 * source_size) x ON true),
last AS (SELECT * FROM filled ORDER BY turn DESC LIMIT 1),
shares AS (SELECT source, source_size, CASE WHEN list_contains(full_ones, coalesce('=' || source, ''))
    THEN CAST(2 * source_size AS DOUBLE) ELSE level * weight END AS target FROM sources, last),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY shuffle, doc_id) - size AS earlier FROM sized),
goals AS (SELECT placed.*, source_size, target, CAST(round(target) AS BIGINT) AS goal, row_number() OVER () AS n
    FROM placed JOIN shares ON placed.source IS NOT DISTINCT FROM shares.source),
offered AS (SELECT n, source, turn, earlier, goal, turn * source_size + earlier AS started, turn * source_size + earlier + size AS ended
    FROM goals, (VALUES (0), (1)) t(turn) WHERE size > 0),
parts AS (SELECT n, source, turn, earlier, goal, started, least(ended, goal) AS ended FROM offered WHERE started < goal
    UNION ALL SELECT n, source, turn, earlier, goal, greatest(started, goal), ended FROM offered WHERE ended > goal),
timed AS (SELECT *, CASE WHEN goal > 0 THEN ended / CAST(goal AS DOUBLE) ELSE 'inf' END AS finish FROM parts),
running AS (SELECT n, ended - started AS words, sum(ended - started) OVER (ORDER BY finish, source NULLS LAST, turn, earlier) - (ended - started) AS ahead FROM timed),
given AS (SELECT n, sum(greatest(0, least(words, (SELECT sum(CAST(round(target) AS BIGINT)) FROM shares) - ahead))) AS words FROM running GROUP BY n)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(words, 0) AS BIGINT) AS taken
FROM goals LEFT JOIN given USING (n)"""

_WARC = """
WITH given AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
hashed AS (SELECT page_id, payload, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS latest FROM given)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (j // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
    CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM hashed"""

_TOPK_SEARCH = """
WITH given AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM given q JOIN given c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10"""

_SHARDING = f"""
WITH RECURSIVE items AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes, array_to_string(list_transform(
    string_split(md5(coalesce(CAST(doc_id AS VARCHAR), '')), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
        '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][CAST('0x' || c AS INTEGER) + 1]), '') AS bits FROM documents),
shards AS (
    SELECT '' AS shard, CAST(sum(bytes) AS BIGINT) AS shard_bytes, min(bits) = max(bits) AS single FROM items
    UNION ALL
    SELECT substr(bits, 1, length(shard) + 1), CAST(sum(bytes) AS BIGINT), min(bits) = max(bits)
    FROM shards JOIN items ON starts_with(bits, shard) WHERE shard_bytes > {sharding.LIMIT_BYTES} AND NOT single GROUP BY 1)
SELECT doc_id, bytes, shard, CAST(length(shard) AS INTEGER) AS depth, shard_bytes
FROM items JOIN shards ON starts_with(bits, shard) WHERE shard_bytes <= {sharding.LIMIT_BYTES} OR single"""


_HARD_NEGATIVES = """
WITH given AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS alike, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM given q JOIN given c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD_JOIN = f"""
WITH RECURSIVE given AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingles FROM given),
entries AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
linked AS (SELECT a.doc_id AS a, b.doc_id AS b FROM entries a JOIN entries b
    ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, b FROM reached r JOIN linked ON r.other = a)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id FROM sets
JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)"""


def _phrase_mining() -> str:
    runs = "\n    UNION ALL ".join(
        f"SELECT lang, {' || chr(32) || '.join(f'w{i}' for i in range(k))} AS phrase, {k} AS size, count(*) AS f FROM ahead"
        f" WHERE w{k - 1} IS NOT NULL GROUP BY 1, 2" + (" HAVING count(*) >= 100" if k > 1 else "")
        for k in range(1, 6)
    )
    ahead = ", ".join(["word AS w0", *(f"lead(word, {k}) OVER w AS w{k}" for k in range(1, 5))])
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, text FROM (
    SELECT lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS text FROM documents)),
listed AS (SELECT lang, piece, regexp_extract_all(text, '[^\\x20\\x09]+') AS words FROM pieces),
numbered AS (SELECT lang, piece, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM listed),
ahead AS (SELECT lang, {ahead} FROM numbered WINDOW w AS (PARTITION BY piece ORDER BY i)),
counted AS ({runs}),
totals AS (SELECT lang, CAST(count(*) AS HUGEINT) AS n FROM numbered GROUP BY lang),
candidates AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS words FROM counted WHERE size > 1),
covered AS (SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN candidates d ON c.lang = d.lang AND d.size > c.size AND d.a >= c.a
    AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')),
cuts AS (SELECT lang, phrase, a, k, array_to_string(words[:k], ' ') AS lead_part, array_to_string(words[k + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates ANTI JOIN covered USING (lang, phrase))),
scored AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n, 1000 * CAST(c.a AS HUGEINT) * n // (CAST(l.f AS HUGEINT) * r.f) AS score
    FROM cuts c JOIN counted l ON c.lang = l.lang AND c.lead_part = l.phrase JOIN counted r ON c.lang = r.lang AND c.rest = r.phrase
    JOIN totals t ON c.lang = t.lang QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n,
    CAST(score AS BIGINT) AS score FROM scored QUALIFY rank <= 2000"""


def _vote(rule: Rule) -> str:
    falling = rule.favour is not None and rule.favour > rule.against
    worse, better = ("<=", ">=") if falling else (">=", "<=")
    value = f"{rule.part} / nullif({rule.whole}, 0)"
    favour = "" if rule.favour is None else f" WHEN {value} {better} {rule.favour} THEN 1"
    return f"CASE WHEN {value} {worse} {rule.against} THEN -1{favour} ELSE 0 END"


def _quality_rules() -> str:
    q, n = quality_rules, len(RULES)
    total = "list_sum(list_transform(range(1, len(ps) + 1), lambda k: {}))"

    def rate(vote: int, weight: str, of: str, first: float) -> str:
        inner = total.format(f"CASE WHEN ps[k].v[j] = {vote} THEN {weight} * ps[k].n ELSE 0.0 END")
        return f"({inner} + {first}) / ({of} + 1)"

    against, favour = rate(-1, "p[k]", "good", q.AGAINST_GOOD), rate(1, "(1 - p[k])", "poor", q.FAVOUR_POOR)
    evidence = (
        f"list_sum(list_transform(range(1, {n + 1}), lambda j: CASE x.v[j] WHEN -1 THEN ln(rates[j].ga / rates[j].pa)"
        " WHEN 1 THEN ln(rates[j].gf / rates[j].pf) ELSE ln((1 - rates[j].ga - rates[j].gf) / (1 - rates[j].pa - rates[j].pf)) END))"
    )
    posterior = f"1 / (1 + exp(-({evidence} + ln(share / (1 - share)))))"
    base = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
    first = f"{{'ga': {q.AGAINST_GOOD}::DOUBLE, 'gf': {q.FAVOUR_GOOD}::DOUBLE, 'pa': {q.AGAINST_POOR}::DOUBLE, 'pf': {q.FAVOUR_POOR}::DOUBLE}}"
    return f"""
WITH RECURSIVE given AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
numbered AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM given),
windows AS (SELECT doc_id, i, string_agg(word, ' ') OVER w AS seen, count(*) OVER w AS n FROM numbered
    WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
twice AS (SELECT doc_id, i FROM windows WHERE n = 5 QUALIFY count(*) OVER (PARTITION BY doc_id, seen) > 1),
repeated AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) FROM twice) GROUP BY doc_id),
counted AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '{q.SYMBOLS}')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '!!')) AS n_exclaims,
    len(list_filter(words, lambda w: regexp_full_match(w, '\\p{{L}}+[.,;:!?]?'))) AS n_plain,
    len(list_filter(words, lambda w: NOT regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))) AS n_marks
    FROM given LEFT JOIN repeated USING (doc_id)),
voted AS (SELECT *, {base} AS base_failed, [{', '.join(map(_vote, RULES))}] AS v FROM counted),
patterns AS (SELECT v, count(*) AS n FROM voted WHERE NOT base_failed GROUP BY v),
listed AS (SELECT list({{'v': v, 'n': n}} ORDER BY v) AS ps FROM patterns),
state AS (
    SELECT 0 AS turn, {q.FIRST_SHARE}::DOUBLE AS share, list_transform(range({n}), lambda j: {first}) AS rates
    UNION ALL
    SELECT turn + 1, (good + {q.FIRST_SHARE}) / (good + poor + 1), list_transform(range(1, {n + 1}), lambda j: {{
        'ga': {against}, 'gf': greatest({rate(1, 'p[k]', 'good', q.FAVOUR_GOOD)}, {favour}),
        'pa': greatest({rate(-1, '(1 - p[k])', 'poor', q.AGAINST_POOR)}, {against}), 'pf': {favour}}})
    FROM (SELECT *, {total.format('p[k] * ps[k].n')} AS good, {total.format('(1 - p[k]) * ps[k].n')} AS poor
        FROM (SELECT turn, share, rates, ps, list_transform(ps, lambda x: {posterior}) AS p FROM state, listed WHERE turn < {q.ROUNDS}))),
last AS (SELECT share, rates FROM state ORDER BY turn DESC LIMIT 1),
judged AS (SELECT x.v AS v, {posterior} AS quality FROM (SELECT unnest(ps) AS x FROM listed), last)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(quality >= 0.5, false) AS kept FROM voted LEFT JOIN judged USING (v)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": _SUBSTRING_DEDUP,
        "op4_source_mixing": _SOURCE_MIXING,
        "op5_warc": _WARC,
        "op7_quality_rules": _quality_rules(),
        "op8_topk_search": _TOPK_SEARCH,
        "op10_sharding": _SHARDING,
        "op11_hard_negatives": _HARD_NEGATIVES,
        "op12_jaccard_join": _JACCARD_JOIN,
        "op13_phrase_mining": _phrase_mining(),
    }
