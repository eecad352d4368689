"""SQL equivalents of text queries that SQL can express, by plain joins and windows."""

from __future__ import annotations

from hopwise.llm import quality, secret_scan

WORDS = "[x FOR x IN regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+') IF x <> '']".format

WARC = """WITH k AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS f FROM k WHERE n >= 1000 GROUP BY d HAVING count(*) > 1),
j AS (SELECT k.*, f, f IS NOT NULL AND page_id IS DISTINCT FROM f AS again FROM k LEFT JOIN m USING (d))
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN f END AS refers_to FROM j"""

LINES = f"""WITH cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
l AS (SELECT doc_id, line_no, w, array_to_string(w, ' ') AS k FROM (SELECT *, {WORDS('line')} AS w FROM cut) WHERE len(w) > 0),
u AS (SELECT k, any_value(w) AS w, len(any_value(w)) AS n, min((doc_id, line_no)) AS pos FROM l GROUP BY k),
v AS (SELECT k, pos, n, g, array_to_string(list_concat(w[1:g], w[g + 2:]), ' ') AS v FROM (SELECT *, unnest(range(n)) AS g FROM u WHERE n >= 5)),
pairs AS (
  SELECT a.k, b.pos FROM v a JOIN v b ON a.v = b.v AND a.g = b.g AND a.n = b.n AND a.k <> b.k
  UNION ALL SELECT a.k, b.pos FROM v a JOIN u b ON a.v = b.k AND a.n = b.n + 1 AND b.n >= 5
  UNION ALL SELECT b.k, a.pos FROM v a JOIN u b ON a.v = b.k AND a.n = b.n + 1 AND b.n >= 5
), best AS (SELECT k, min(pos) AS other FROM pairs GROUP BY k),
judged AS (SELECT l.doc_id, l.line_no, u.pos AS own, CASE WHEN other < u.pos THEN other ELSE u.pos END AS keeper FROM l JOIN u USING (k) LEFT JOIN best USING (k))
SELECT doc_id, CAST(line_no AS INT) AS line_no, keeper[1] AS keeper_doc_id, CAST(keeper[2] AS INT) AS keeper_line_no, CASE WHEN keeper = own THEN 0 ELSE 1 END AS distance
FROM judged WHERE keeper < (doc_id, line_no)"""


def _weight(column: str, weights: dict[str, int], default: int) -> str:
    return f"(CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items()) + f" ELSE {default} END)" if weights else str(default)


def mixing(levels: list[tuple[str, str, dict[str, int], int]], max_epochs: int, seed: int) -> str:
    """levels: name, value in SQL, weights, default weight."""
    names = [x[0] for x in levels]
    sql = "WITH r AS (SELECT doc_id, " + ", ".join(f"coalesce({value}, '') AS {name}" for name, value, _, _ in levels)
    sql += f", len({WORDS('text')})::BIGINT AS n_tokens, md5(coalesce(text, '')) AS t FROM documents),\nleaves AS (SELECT {', '.join(names)}, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY ALL HAVING sum(n_tokens) > 0)"
    above = "(SELECT sum(n_tokens)::BIGINT FROM r)"
    for k, (name, _, weights, default) in enumerate(levels):
        keys, parents = ", ".join(names[: k + 1]), ", ".join(names[:k]) or "1"
        given = f"b{k - 1}.budget" if k else above
        join = f" JOIN b{k - 1} USING ({', '.join(names[:k])})" if k else ""
        sql += f""",
n{k} AS (SELECT g.*, {given} AS given FROM (SELECT {keys}, sum(tokens)::BIGINT * {max_epochs} AS capacity, {_weight(name, weights, default)} AS weight FROM leaves GROUP BY {keys}) g{join}),
o{k} AS (SELECT *, row_number() OVER w AS place, coalesce(sum(capacity) OVER (PARTITION BY {parents} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
  sum(weight) OVER (PARTITION BY {parents} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM n{k} WINDOW w AS (PARTITION BY {parents} ORDER BY capacity::DOUBLE / weight, {name})),
f{k} AS (SELECT *, min(CASE WHEN capacity::HUGEINT * rest > (given - before_)::HUGEINT * weight THEN place END) OVER (PARTITION BY {parents}) AS open_ FROM o{k}),
h{k} AS (SELECT *, max(CASE WHEN place = open_ THEN before_ END) OVER (PARTITION BY {parents}) AS lb, max(CASE WHEN place = open_ THEN rest END) OVER (PARTITION BY {parents}) AS lr FROM f{k}),
b{k} AS (SELECT {keys}, CASE WHEN open_ IS NULL OR place < open_ THEN capacity ELSE ((given - lb)::HUGEINT * weight // lr) END::BIGINT AS budget FROM h{k})"""
    using = ", ".join(names)
    last = f"b{len(levels) - 1}"
    return sql + f""",
budgets AS (SELECT *, (budget // tokens)::INT AS full_, budget - (budget // tokens) * tokens AS left_ FROM {last} JOIN leaves USING ({using})),
placed AS (SELECT *, md5(concat_ws(':', '{seed}', full_, doc_id, t)) AS p FROM r JOIN budgets USING ({using}) WHERE n_tokens > 0 AND budget > 0),
upto AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {using} ORDER BY p) AS c FROM placed)
SELECT doc_id, {using}, n_tokens, full_ + CASE WHEN c <= left_ THEN 1 ELSE 0 END AS copies FROM upto WHERE full_ > 0 OR c <= left_"""


def _ratio(statistic: str) -> str:
    return "(" + statistic.replace("100 *", "100.0::DOUBLE *").replace("word_chars /", "word_chars::DOUBLE /") + ")"


def quality_rules(alpha: float, delta: float, rules: tuple[quality.Rule, ...] = quality.RULES) -> str:
    """Counts, cutoffs by exact binomial tails (sums of their terms), and verdicts."""
    listed = ", ".join(f"({k}, '{r.name}', [{', '.join(f'{float(c)}::DOUBLE' for c in r.ladder)}])" for k, r in enumerate(rules))
    values = " UNION ALL ".join(f"SELECT *, {k} AS rule, {_ratio(r.statistic)} AS value FROM {{0}}" for k, r in enumerate(rules))
    share = alpha / len(rules)
    term = f"exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({share}::DOUBLE) + (n - x) * ln(1 - {share}::DOUBLE))"
    return f"""WITH base AS (SELECT d.*, coalesce(text, '') AS t, {WORDS("coalesce(text, '')")} AS w,
  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM documents d),
windows AS (SELECT doc_id, unnest(range(len(w) - 2)) AS k, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) AS g FROM base WHERE len(w) > 2),
twins AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM twins CROSS JOIN range(3) r(j) GROUP BY doc_id),
counted AS (
  SELECT doc_id, lang, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g'))::BIGINT AS n_capitals, length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS n_marks
  FROM base LEFT JOIN covered USING (doc_id)
), based AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM counted),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
holdout AS (SELECT DISTINCT ON (lang, t) * FROM based WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
rules(rule, name, ladder) AS (VALUES {listed}),
tried AS (SELECT lang, rule, i, any_value(ladder[i]) AS cutoff, count(*) AS n, count(CASE WHEN value > ladder[i] THEN 1 END) AS rejected
  FROM ({values.format("holdout")}) JOIN rules USING (rule) CROSS JOIN range(1, 201) r(i) WHERE i <= len(ladder) GROUP BY lang, rule, i),
judged AS (SELECT *, CASE WHEN rejected >= n * {share}::DOUBLE THEN 1.0::DOUBLE ELSE list_sum([{term} FOR x IN range(rejected + 1)]) END AS tail FROM tried),
passed AS (SELECT *, min(CASE WHEN tail <= {delta}::DOUBLE / ((SELECT count(DISTINCT coalesce(lang, '')) FROM holdout) * {len(rules)}) THEN 1 ELSE 0 END) OVER (PARTITION BY lang, rule ORDER BY i) AS pass FROM judged),
cutoffs AS (SELECT lang, rule, arg_max(cutoff, i) AS cutoff FROM passed WHERE pass = 1 GROUP BY lang, rule),
failures AS (SELECT doc_id, string_agg(name, ',' ORDER BY v.rule) AS failed FROM ({values.format("based")}) v JOIN cutoffs c ON c.rule = v.rule AND c.lang IS NOT DISTINCT FROM v.lang JOIN rules r ON r.rule = v.rule WHERE value > cutoff GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, lang AS stratum, coalesce(failed, '') AS failed_rules
FROM based LEFT JOIN failures USING (doc_id)"""


_TOKENS = "[x FOR x IN regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+') IF x <> '']".format

#: Every two equal tokens of a text and an item are a point of a diagonal; on each, the longest stretch is sought between all points.
OVERLAPS = f"""WITH d AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {_TOKENS("text")} AS w FROM documents)),
items AS (SELECT DISTINCT item_id, {_TOKENS("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
b AS (SELECT item_id, len(w) AS n, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS place FROM items WHERE len(w) >= 5),
met AS (SELECT doc_id, item_id, n, pos - place AS diagonal, place, row_number() OVER (PARTITION BY doc_id, item_id, pos - place ORDER BY place) AS nth, count(*) OVER (PARTITION BY doc_id, item_id, pos - place) AS c FROM d JOIN b USING (token)),
dense AS (SELECT * FROM met WHERE c >= ceil(0.8::DOUBLE * least(n, 13))),
stretches AS (
  SELECT x.doc_id, x.item_id, x.diagonal, x.place AS first, y.place - x.place + 1 AS len, y.nth - x.nth + 1 AS equal FROM dense x JOIN dense y USING (doc_id, item_id, diagonal)
  WHERE x.n >= 13 AND y.place - x.place >= 12 AND 5 * (y.nth - x.nth + 1) >= 4 * (y.place - x.place + 1)
), longest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY len DESC, first) AS rn FROM stretches) WHERE rn = 1
), found AS (
  SELECT doc_id, item_id, diagonal, first, len, equal FROM longest
  UNION ALL SELECT doc_id, item_id, diagonal, greatest(0, -diagonal), n, count(*) FROM dense WHERE n < 13 GROUP BY doc_id, item_id, diagonal, n HAVING 5 * count(*) >= 4 * n
), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY equal DESC, first + diagonal, diagonal) AS rn FROM found)
SELECT doc_id, item_id, CAST(first + diagonal AS INT) AS doc_start, CAST(first AS INT) AS item_start, CAST(len AS INT) AS n_tokens, CAST(equal AS INT) AS n_equal, round(equal / len::DOUBLE, 6) AS similarity
FROM best WHERE rn = 1"""


def _spans(name: str, pattern: str, rank: int, group: int, least: int, more: str = "true") -> str:
    """name: doc_id, start, end_, rank, value of the matches of a pattern, by the lengths of gaps and matches before each."""
    quoted = pattern.replace("'", "''")
    return f"""{name}_p AS (SELECT doc_id, regexp_split_to_array(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS hits, regexp_extract_all(t, '{quoted}', {group}) AS vals FROM docs WHERE regexp_matches(t, '{quoted}')),
{name}_k AS (SELECT doc_id, unnest(hits) AS hit, unnest(vals) AS value, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS k FROM {name}_p),
{name}_s AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) AS end_ FROM {name}_k),
{name} AS (SELECT doc_id, end_ - length(hit) AS start, end_, {rank} AS rank, value FROM {name}_s WHERE length(value) >= {least} AND {more})"""


def secrets(min_owners: int, min_repos: int) -> str:
    """Spans of the base kinds and of mixed tokens, verdicts by owners and repositories, for each document."""
    kinds = "['" + "', '".join(secret_scan.KINDS) + "']"
    mixed = f"NOT regexp_matches(value, '^(?:{secret_scan.ASSIGN})') AND NOT regexp_matches(value, '{secret_scan.ACCESS}|{secret_scan.HEX}') AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')".replace(
        secret_scan.ASSIGN, secret_scan.ASSIGN.replace("'", "''")
    )
    loose = f"(?:{secret_scan.ASSIGN}|{secret_scan.MIXED})"
    listed = "coalesce(string_agg({0}[rank + 1] || ':' || start || ':' || end_, ',' ORDER BY start, rank){1}, '')".format
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
{_spans("assign", secret_scan.ASSIGN, 0, 1, secret_scan.ASSIGN_MIN)},
{_spans("access", secret_scan.ACCESS, 1, 0, 0)},
{_spans("hex", secret_scan.HEX, 2, 0, 0)},
{_spans("mixed", loose, 3, 0, 0, mixed)},
every AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex UNION ALL SELECT * FROM mixed),
by_value AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos, len(list_distinct(string_split(value, ''))) < 7 AS filler FROM every JOIN docs USING (doc_id) GROUP BY value),
verdicts AS (SELECT value, CASE WHEN owners >= {min_owners} OR (owners > 1 AND repos >= {min_repos}) THEN 'example' WHEN filler THEN 'filler' WHEN owners = 1 AND repos < {min_repos} THEN 'live' WHEN owners = 1 THEN 'house' ELSE 'shared' END AS verdict FROM by_value),
told AS (SELECT * FROM every JOIN verdicts USING (value))
SELECT d.doc_id, count(CASE WHEN rank = 0 THEN 1 END) AS n_assign, count(CASE WHEN rank = 1 THEN 1 END) AS n_access, count(CASE WHEN rank = 2 THEN 1 END) AS n_hex,
  sha256({listed(kinds, " FILTER (rank < 3)")}) AS base_sha256, {listed(kinds, " FILTER (rank < 3 OR verdict = 'live')")} AS spans, count(CASE WHEN verdict = 'live' THEN 1 END) AS n_live,
  count(CASE WHEN verdict = 'example' THEN 1 END) AS n_example, {listed(kinds, " FILTER (verdict = 'live')")} AS live
FROM docs d LEFT JOIN told t USING (doc_id) GROUP BY d.doc_id"""
