"""DuckDB SQL for the queries of the domain, from the same stand-in tables."""

from __future__ import annotations

from . import rules
from .adapters import duckdb_cte, quoted
from .functions.text import any_of

ORACLES: dict[str, str] = {}


def oracle(name: str, tables: list[str], body: str, *ctes: str) -> None:
    parts = ([duckdb_cte(*tables)] if tables else []) + list(ctes)
    ORACLES[name] = (f"WITH {', '.join(parts)} " if parts else "") + body


def names(values: list[str]) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def array(values: list[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def has_any(expr: str, phrases: list[str]) -> str:
    return f"coalesce(regexp_matches({expr}, {quoted(any_of(phrases))}), false)"


def half_up(expr: str, digits: int = 2) -> str:
    scale = f"{10**digits}::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.5::DOUBLE) / {scale})"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def slug_of(expr: str) -> str:
    return f"lower(regexp_replace(regexp_replace(regexp_replace({strip(expr)}, '^(https://github\\.com/)+', ''), '^(http://github\\.com/)+', ''), '/+$', ''))"


def named_verb(expr: str) -> str:
    gaps = [f"{strip(f'regexp_extract({expr}, {quoted(f'(?s){v}(.*?){e}')}, 1)')} NOT IN ('', 'in', 'to')" for v, e in rules.NAMED_VERBS]
    return f"coalesce({' OR '.join(gaps)}, false)"


def in_place(e: str) -> str:
    return f"({has_any(e, rules.IN_PLACE)} OR {named_verb(e)})"


def targeted(e: str) -> str:
    return f"({has_any(e, rules.TARGETED)} OR {named_verb(e)})"


def after(expr: str, marker: str) -> str:
    return f"CASE WHEN strpos({expr}, {marker}) > 0 THEN substr({expr}, strpos({expr}, {marker}) + length({marker})) END"


def before(expr: str, marker: str) -> str:
    return f"CASE WHEN strpos({expr}, {marker}) > 0 THEN substr({expr}, 1, strpos({expr}, {marker}) - 1) END"


def clean(expr: str) -> str:
    name = f"regexp_replace({expr}, {quoted('^[\\s`\"' + chr(39) + ':-]+')}, '')"
    name = f"regexp_extract({name}, {quoted('(?s)^(.*?)(?:' + any_of(rules.ORIGIN_STOPS) + '|\\z)')}, 1)"
    name = f"regexp_replace({strip(name)}, {quoted('^[`\"' + chr(39) + ']+|[`\"' + chr(39) + ']+$')}, '', 'g')"
    for article in rules.ARTICLES:
        name = f"regexp_replace({name}, '^{article}', '')"
    return f"array_to_string(list_filter(regexp_split_to_array({name}, '\\s+'), lambda w: w <> '')[1:5], ' ')"


def first_name(values: str) -> str:
    return f"list_filter({values}, lambda n: coalesce(n <> '', false))[1]"


def origin_in(expr: str) -> str:
    return first_name(f"list_transform({array(rules.ORIGIN_MARKERS)}, lambda m: {clean(after(expr, 'm'))})")


def subject_in(expr: str) -> str:
    head = f"regexp_replace({before(expr, 'm')}, '\\s+$', '')"
    clause = strip(f"regexp_replace({head}, '(?s)^.*[:—.;|]', '')")
    return first_name(f"list_transform({array(rules.SUBJECT_MARKERS)}, lambda m: {clean(strip(f'regexp_replace({clause}, {quoted('(?s)^.*,')}, {quoted('')})'))})")


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}]'), lambda w: strlen(w) >= 3 AND NOT list_contains({array(rules.STOPWORDS)}, w))"


def overlap(a: str, b: str) -> str:
    alike = "(t = u OR (strlen(t) >= 6 AND strlen(u) >= 6 AND (starts_with(u, t) OR starts_with(t, u))))"
    return f"coalesce(len(list_filter({a}, lambda t: len(list_filter({b}, lambda u: {alike})) > 0)) > 0, false)"


def compact(expr: str) -> str:
    return f"regexp_replace({expr}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def same(a: str, b: str, least: int) -> str:
    a, b = compact(a), compact(b)
    return f"coalesce(strlen({a}) >= {least} AND strlen({b}) >= {least} AND (starts_with({a}, {b}) OR starts_with({b}, {a})), false)"


def product_in(expr: str) -> str:
    outer, inner = "[^\\p{L}\\p{N}]", "[^\\p{L}\\p{N}-]"
    words = f"list_filter(regexp_split_to_array({before(expr, 'm')}, '\\s+'), lambda w: w <> '')[-4:]"
    bare = f"regexp_replace(w, '^{outer}+|{outer}+$', '', 'g')"
    telling = f"list_position(list_transform({words}, lambda w: NOT list_contains({array(rules.STOPWORDS + rules.FLUFF)}, {bare})), true)"
    named = f"list_filter(list_transform({words}[{telling}:], lambda w: regexp_replace(w, '^{inner}+|{inner}+$', '', 'g')), lambda w: w <> '')"
    return first_name(f"list_transform({array(rules.PRODUCT_MARKERS)}, lambda m: CASE WHEN {telling} > 0 THEN array_to_string({named}, ' ') END)")


def title_of(expr: str) -> str:
    return f"CASE WHEN coalesce({after(expr, quoted(': '))} <> '', false) THEN {after(expr, quoted(': '))} ELSE {expr} END"


def discussed(title: str) -> str:
    return f"(contains({title}, 'rust') AND {has_any(title, rules.DISCUSSION_STEMS)})"


def own_migration(title: str) -> str:
    inside = f"(strlen({compact('slug')}) >= 4 AND contains({compact(title)}, {compact('slug')}))"
    own = f"(NOT {has_any(title, rules.WISHES)} AND {has_any(title, rules.OWN_CODE)})"
    return f"({discussed(title)} AND ({overlap(tokens(title), 'own')} OR {overlap(tokens(title), 'owners')} OR {inside} OR {own}))"


def slug(expr: str) -> str:
    name = f"lower(split_part({expr}, '/', -1))"
    cases = " ".join(f"WHEN ends_with({name}, '{s}') AND strlen({name}) >= {3 + len(s)} THEN left({name}, length({name}) - {len(s)})" for s in rules.SLUG_SUFFIXES)
    return f"CASE {cases} ELSE {name} END"


def agent(expr: str) -> str:
    return "CASE " + " ".join(f"WHEN {has_any(f'lower({expr})', needles)} THEN '{name}'" for name, needles in rules.AGENTS) + " END"


IGNORED = quoted(f"(?:{any_of(rules.IGNORED_SUFFIXES + rules.IGNORED_FILES)})$|{any_of(rules.IGNORED_FOLDERS)}")


def language(path: str = "path") -> str:
    file = f"split_part({path}, '/', -1)"
    ext = f"split_part({file}, '.', -1)"
    bare = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in rules.FILE_NAMES.items())
    table = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in rules.EXTENSIONS.items())
    return f"CASE WHEN regexp_matches(lower({path}), {IGNORED}) THEN NULL WHEN {ext} = {file} THEN CASE {file} {bare} END ELSE CASE {ext} {table} END END"


# Stored rows with their lists, and candidates of them.
SIGNALS = """from_json(signals, '[{"kind":"VARCHAR","detail":"VARCHAR","url":"VARCHAR"}]')"""
AGENTS = """array_to_string(from_json(ai_agents, '["VARCHAR"]'), ',')"""
EXEMPLARS = f"x AS (SELECT slug, min(line_no) AS place FROM (SELECT {slug_of("split_part(value, '#', 1)")} AS slug, line_no FROM a_exemplar_lines WHERE {strip("split_part(value, '#', 1)")} <> '') e GROUP BY slug)"
ORIGINS = f"""o AS (SELECT slug, max_by(label, line_no) AS label FROM (
  SELECT {slug_of("split_part(value, '|', 1)")} AS slug, {strip("substr(value, strpos(value, '|') + 1)")} AS label, line_no FROM a_origin_lines
  WHERE contains(value, '|') AND NOT starts_with({strip("value")}, '#')) e WHERE slug <> '' AND label <> '' GROUP BY slug)"""

GENERIC = quoted(any_of(rules.GENERIC_CONTAINED) + "|" + "|".join(f"^{s}" for s in rules.GENERIC_STARTS))
CANDIDATES = f"""c0 AS (SELECT {strip("regexp_replace(repo_url, '^https://github.com/', '')")} AS full_name, {slug_of("repo_url")} AS key_slug, repo_url, description, stars, {SIGNALS} AS sig, rust_percentage, original_language,
    (original_language IS NULL OR rust_percentage >= 50) AS is_primary, history_from_language AS from_language, transition_magnitude AS magnitude, history_rust_before, history_rust_after, total_commits_analyzed, first_detected,
    (coalesce(transition_magnitude, 0) >= 25 AND coalesce(history_rust_after, 0) >= 40 AND history_from_language IS NOT NULL AND coalesce(history_rust_before, 100) <= 35) AS strong FROM a_stored),"""
ORIGINATED = f"""c1 AS (SELECT c0.*, lower(concat(coalesce(description, ''), array_to_string(list_transform(sig, lambda s: concat(' ', s.detail)), ''))) AS body, {slug('full_name')} AS slug, lower(description) AS ld, label,
    list_filter(list_transform(sig, lambda s: lower(s.detail)), lambda d: NOT regexp_matches(d, {GENERIC})) AS told FROM c0 LEFT JOIN o ON key_slug = o.slug),
c2 AS (SELECT *, {tokens('slug')} AS own, {tokens("split_part(full_name, '/', 1)")} AS owners,
    coalesce(label, {origin_in('ld')}, {subject_in('ld')}, list_filter(list_transform(told, lambda d: coalesce({origin_in('d')}, {subject_in('d')})), lambda n: n IS NOT NULL)[1]) AS origin FROM c1)"""
CANDIDATES += "\n" + ORIGINATED


def _evidence() -> str:
    def overlaps(name: str) -> str:
        return f"({overlap(tokens(name), 'own')} OR {overlap(tokens(name), 'owners')})"

    dashed = "replace(product, ' ', '-')"
    by_product = f"coalesce({overlaps('product')} OR contains({dashed}, slug) OR contains(slug, {dashed}) OR {same('product', 'slug', 5)}, false)"
    by_origin = f"coalesce({overlaps('origin')} OR {same('origin', 'slug', 6)}, false)"
    by_rewrite = " OR ".join(overlap(tokens(clean(after("body", quoted(m)))), "own") for m in rules.REWRITE_OF_MARKERS)
    talk = "list_filter(sig, lambda s: s.kind IN ('pull-request', 'issue'))"
    return f"""c3 AS (SELECT *, {product_in('body')} AS product, list_transform({talk}, lambda s: lower({title_of('s.detail')})) AS titles FROM c2),
c4 AS (SELECT *, ({by_product} OR {by_origin} OR {by_rewrite} OR len(list_filter(titles, lambda t0: {own_migration('t0')})) > 0) AS identity,
    {in_place('body')} AS inplace, {has_any('body', rules.EXTERNAL_PORT)} AS external, {has_any('body', rules.COMPETITOR)} AS competitor, {targeted('body')} AS target,
    ({has_any('body', rules.API_MARKERS)} OR {has_any('origin', rules.API_MARKERS)}) AS api, len(list_filter(titles, lambda t0: {discussed('t0')} AND NOT {has_any('t0', rules.WISHES)})) > 0 AS pr,
    coalesce(lower(original_language) NOT IN {names(rules.NOISE_LANGUAGES)}, false) AS is_real, coalesce(strong AND lower(from_language) NOT IN {names(rules.NOISE_LANGUAGES)}, false) AS hist FROM c3),
c5 AS (SELECT *, CASE WHEN api THEN 'neither' WHEN identity AND (hist OR pr) THEN 'rewrite'
    WHEN (competitor OR external) AND NOT identity AND (origin IS NOT NULL OR is_real OR competitor) THEN 'replacement'
    WHEN hist AND (inplace OR external OR competitor) AND NOT identity THEN 'replacement'
    WHEN identity AND NOT hist AND NOT pr AND (inplace OR external) THEN 'replacement'
    WHEN (external OR competitor) AND (origin IS NOT NULL OR is_real OR competitor) THEN 'replacement'
    WHEN inplace AND (is_real OR target) AND NOT identity THEN 'replacement' ELSE 'neither' END AS kind FROM c4)"""


WEIGHTS = "CASE s.kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in rules.SIGNAL_WEIGHTS.items()) + f" ELSE {rules.OTHER_WEIGHT} END"


def text_points(sig: str) -> str:
    return f"least(coalesce(list_sum(list_transform({sig}, lambda s: {WEIGHTS})), 0) / 100.0::DOUBLE, 0.60::DOUBLE)"


def strong_signal(description: str, sig: str) -> str:
    def speaks(e: str) -> str:
        return f"({has_any(e, rules.COMPETITOR)} OR {targeted(e)} OR {in_place(e)})"

    heard = f"len(list_filter(list_transform(list_filter({sig}, lambda s: s.kind IN ('repo-search', 'pull-request')), lambda s: lower(s.detail)), lambda d: {speaks('d')})) > 0"
    return f"({speaks(f'lower(coalesce({description}, {quoted("")}))')} OR {heard})"


def confidence(kind: str) -> str:
    share = "(rust_percentage / 100.0::DOUBLE)"
    lang = f"(CASE WHEN original_language IS NOT NULL THEN {share} * 0.4::DOUBLE ELSE {share} * 0.1::DOUBLE END + CASE WHEN is_primary THEN CASE WHEN original_language IS NOT NULL THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END ELSE 0::DOUBLE END)"
    hist = "(CASE WHEN strong THEN 0.20::DOUBLE + coalesce(least(magnitude / 100.0::DOUBLE * 0.25::DOUBLE, 0.15::DOUBLE), 0) + CASE WHEN from_language IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END ELSE 0 END)"
    total = f"least({text_points('sig')} + least({lang}, 0.50::DOUBLE) + least({hist}, 0.35::DOUBLE), 1.0::DOUBLE)"
    total = f"(CASE WHEN {kind} = 'rewrite' THEN least({total} + 0.05::DOUBLE, 1.0::DOUBLE) ELSE {total} END)"
    cap = f"CASE WHEN original_language IS NOT NULL THEN 1.0::DOUBLE WHEN {strong_signal('description', 'sig')} THEN 0.55::DOUBLE ELSE 0.12::DOUBLE END"
    return half_up(f"CASE WHEN {kind} = 'neither' THEN 0::DOUBLE ELSE least({total}, {cap}) END")


# Sources
GAP = "CASE WHEN k % 7 = 0 THEN 0 ELSE {0} END AS {0}"
oracle("read_repo_listing", ["repos"], f"SELECT full_name, html_url, description, readme, language, {GAP.format('stars')}, {GAP.format('forks')}, {GAP.format('open_issues')} FROM a_repos")
ISSUES = "i AS (SELECT k, split_part(repository_url, '/repos/', -1) AS full_name, CASE WHEN pull_request IS NULL THEN 'issue' ELSE 'pull-request' END AS kind, title, html_url AS url, state FROM a_issues)"
oracle("read_issue_listing", ["issues"], "SELECT full_name, kind, title, url, state FROM i", ISSUES)
oracle("read_languages", ["languages"], "SELECT * FROM a_languages")
oracle("parse_numstat_log", ["commits", "changes"], """SELECT c.repo, c.commit_seq, ts, subject, coalesce(trailer, '') AS coauthors, files, added, removed, last_path FROM a_commits c
LEFT JOIN (SELECT repo, commit_seq, count(*) AS files, sum(CASE WHEN added % 50 = 0 THEN 0 ELSE added END)::BIGINT AS added, sum(removed)::BIGINT AS removed, max(path) AS last_path FROM a_changes GROUP BY ALL) f ON f.repo = c.repo AND f.commit_seq = c.commit_seq""")
oracle("read_exemplars", ["exemplar_lines"], "SELECT slug, place FROM x", EXEMPLARS)
oracle("read_origins", ["origin_lines"], "SELECT slug, label FROM o", ORIGINS)
oracle("load_projects", ["stored"], f"""SELECT repo_url, 0::BIGINT AS forks, stars, confidence, array_to_string(list_transform({SIGNALS}, lambda s: s.kind), ',') AS kinds, coalesce({AGENTS}, '') AS agents,
rewrite_pr_title AS pr_title, CASE WHEN rewrite_pr_title IS NULL THEN 0 ELSE 1 END AS prs FROM a_stored""")
oracle("unsafe_share", ["repos"], f"""SELECT k, CASE WHEN y > 0 THEN {half_up('x / y * 100')} END AS unsafe_percentage FROM (SELECT k,
CASE k % 3 WHEN 0 THEN (k % 9 + 1)::DOUBLE WHEN 1 THEN (k % 9 + k % 13)::DOUBLE END AS x, CASE k % 3 WHEN 0 THEN (k % 90 + k % 9 + k % 13 + 1)::DOUBLE WHEN 1 THEN (k % 90 + 20)::DOUBLE END AS y FROM a_repos) r""")

# Scalars
oracle("normalize_slug", ["repos"], "SELECT k, lower(full_name) AS slug FROM a_repos")
oracle("normalize_repo_url", ["repos"], "SELECT k, html_url AS url FROM a_repos")
oracle("is_ignored_path", ["changes"], f"SELECT repo, commit_seq, file_seq, path, regexp_matches(lower(path), {IGNORED}) AS ignored FROM a_changes")
oracle("language_from_path", ["changes"], f"SELECT repo, commit_seq, file_seq, path, {language()} AS lang FROM a_changes")
oracle("is_application_language", ["languages"], f"SELECT full_name, lang, lower(lang) NOT IN {names(rules.NOISE_LANGUAGES)} AS application FROM a_languages")
oracle("sanitize_language", ["languages"], f"SELECT full_name, lang, CASE WHEN lower(lang) NOT IN {names([*rules.NOISE_LANGUAGES, 'rust'])} THEN lang END AS sanitized FROM a_languages")
oracle("truncate_title", ["issues"], "SELECT k, CASE WHEN length(title) > 120 THEN concat(left(title, 120), '…') ELSE title END AS title FROM a_issues")
oracle("combined_text", ["stored"], f"SELECT repo_url, lower(concat(coalesce(description, ''), array_to_string(list_transform({SIGNALS}, lambda s: concat(' ', s.detail)), ''))) AS body FROM a_stored")
oracle("phrase_flags", ["texts"], f"SELECT doc_id, {in_place('body')} AS in_place, {has_any('body', rules.EXTERNAL_PORT)} AS external_port, {has_any('body', rules.COMPETITOR)} AS competitor, {targeted('body')} AS targeted, {has_any('body', rules.API_MARKERS)} AS api FROM a_texts")
oracle("named_migration_verb", ["texts"], f"SELECT doc_id, {named_verb('body')} AS named FROM a_texts")
oracle("extract_named_origin", ["texts"], f"SELECT doc_id, {origin_in('body')} AS origin FROM a_texts")
oracle("extract_rewritten_subject", ["texts"], f"SELECT doc_id, {subject_in('body')} AS subject FROM a_texts")
oracle("named_origin", ["stored", "origin_lines"], "SELECT full_name, origin AS named_origin FROM c2", ORIGINS, CANDIDATES)
oracle("strong_rewrite_signal", ["stored"], f"SELECT repo_url, {strong_signal('description', 'sig')} AS strong_signal FROM (SELECT repo_url, description, {SIGNALS} AS sig FROM a_stored) s0")
oracle("significant_tokens", ["texts"], f"SELECT doc_id, array_to_string({tokens('body')}, ',') AS tokens FROM a_texts")
oracle("product_slug", ["repos"], f"SELECT full_name, {slug('full_name')} AS slug FROM a_repos")
oracle("token_overlap", ["repos"], f"SELECT k, {overlap(tokens('description'), tokens('full_name'))} AS overlap FROM a_repos")
oracle("compact_identity", ["repos"], f"SELECT k, {same('a', 'b', 3)} AS same FROM (SELECT k, split_part(lower(description), ' ', 1) AS a, {slug('full_name')} AS b FROM a_repos) r")
oracle("product_before_phrase", ["texts"], f"SELECT doc_id, {product_in('body')} AS product FROM a_texts")
TITLED = "t AS (SELECT k, lower(title) AS title, html_url FROM a_issues)"
oracle("signal_title", ["issues"], "SELECT k, title FROM a_issues")
oracle("migration_discussion", ["issues"], f"SELECT k, {discussed('title')} AS discussed, {has_any('title', rules.WISHES)} AS wishful FROM t", TITLED)
oracle("pr_relevance", ["issues"], "SELECT k, (" + " + ".join(f"CASE WHEN {has_any('title', p)} THEN {n} ELSE 0 END" for n, p in rules.RELEVANCE) + ")::BIGINT AS points FROM t", TITLED)
oracle("pr_number", ["issues"], "SELECT k, CASE WHEN k % 4 <> 0 THEN k END AS number FROM a_issues")
oracle("product_migration_signal", ["stored", "origin_lines"], f"SELECT full_name, s.url AS url, {own_migration('title')} AS own_migration FROM (SELECT *, lower({title_of('s.detail')}) AS title FROM (SELECT full_name, slug, own, owners, unnest(sig) AS s FROM c2) u WHERE s.kind <> 'repo-search') v", ORIGINS, CANDIDATES)
oracle("identity_continuity", ["stored", "origin_lines"], "SELECT full_name, identity FROM c4", ORIGINS, CANDIDATES, _evidence())
oracle("classify_kind", ["stored", "origin_lines"], "SELECT full_name, kind AS project_kind FROM c5", ORIGINS, CANDIDATES, _evidence())
oracle("match_ai_agent", ["commits"], f"SELECT o_orderkey, {agent('trailer')} AS agent FROM a_commits")
oracle("duration_days", ["commits"], "SELECT repo, greatest((max(ts) - min(ts)) // 86400, 1)::BIGINT AS days, 1::BIGINT AS unknown FROM a_commits GROUP BY repo")
oracle("round_half_up", ["repos"], f"SELECT k, {half_up('k::DOUBLE / 7.0::DOUBLE', 1)} AS one, {half_up('k::DOUBLE / 7.0::DOUBLE', 2)} AS two FROM a_repos")
oracle("strong_from_stored", ["stored", "origin_lines"], "SELECT repo_url, strong FROM c0", ORIGINS, CANDIDATES)
WHOLE = "floor({} + 0.5::DOUBLE)::BIGINT"
oracle("display_metrics", ["stored"], f"""SELECT *, 100 - added_pct AS removed_pct, after_pct - before_pct AS delta_pct FROM (SELECT repo_url, {WHOLE.format('confidence * 100.0::DOUBLE')} AS confidence_pct,
{WHOLE.format('coalesce(lines_added, 0) / (CASE WHEN coalesce(lines_added, 0) + coalesce(lines_removed, 0) = 0 THEN 1 ELSE coalesce(lines_added, 0) + coalesce(lines_removed, 0) END)::DOUBLE * 100.0::DOUBLE')} AS added_pct,
{WHOLE.format('ai_assist_score * 100.0::DOUBLE')} AS ai_pct, CASE WHEN history_rust_after IS NOT NULL THEN {WHOLE.format('history_rust_before')} END AS before_pct,
CASE WHEN history_rust_before IS NOT NULL THEN {WHOLE.format('history_rust_after')} END AS after_pct, {WHOLE.format('rust_percentage')} AS rust_pct FROM a_stored) d""")


# Rules
def _rule(rule: rules.Rule) -> str:
    body = "lower(concat_ws(' ', description, readme))" if rule.readme else "lower(concat_ws(' ', full_name, description))"
    parts = [f"contains({'lower(title)' if rule.kind else body}, {quoted(p)})" for p in rule.phrases]
    parts += [f"language = '{rule.language}'"] if rule.language else []
    parts += [f"stars > {rule.stars}"] if rule.stars is not None else []
    parts += [f"kind = '{rule.kind}'"] if rule.kind else []
    return " AND ".join(parts)


REPO_HITS = "rh AS (" + " UNION ALL ".join(f"SELECT full_name, {n} AS rule_no, {quoted(r.label)} AS label, stars, description, html_url FROM a_repos WHERE {_rule(r)}" for n, r in enumerate(rules.REPO_RULES)) + ")"
ISSUE_HITS = "ih AS (" + " UNION ALL ".join(
    f"SELECT i.full_name, i.url, {n + len(rules.REPO_RULES)} AS rule_no, concat({quoted(r.label)}, ': ', CASE WHEN length(title) > 120 THEN concat(left(title, 120), '…') ELSE title END) AS detail, kind FROM i JOIN a_repos r ON r.full_name = i.full_name WHERE {_rule(r)}"
    for n, r in enumerate(rules.ISSUE_RULES)
) + ")"
oracle("match_repo_rules", ["repos"], "SELECT full_name, rule_no, label FROM rh", REPO_HITS)
oracle("match_issue_rules", ["repos", "issues"], "SELECT full_name, url, rule_no, detail FROM ih", ISSUES, ISSUE_HITS)
oracle("rule_top_k", ["repos"], "SELECT rule_no, rank, full_name, stars FROM (SELECT *, row_number() OVER (PARTITION BY rule_no ORDER BY stars DESC, full_name)::INTEGER AS rank FROM rh) r WHERE rank <= 300", REPO_HITS)
SEEDS = "'exemplar' AS kind, 'curated exemplar rewrite (priority target)' AS detail, concat('https://github.com/', slug) AS url"
SIGNALS_OF = f"""sg AS (SELECT * FROM (SELECT full_name, rule_no, row_number() OVER (PARTITION BY rule_no ORDER BY stars DESC, full_name)::INTEGER AS rank, 'repo-search' AS kind, label AS detail, html_url AS url, stars, description FROM rh
  UNION ALL SELECT full_name, rule_no, row_number() OVER (PARTITION BY rule_no ORDER BY url, full_name)::INTEGER AS rank, kind, detail, url, 0, NULL FROM ih) s WHERE rank <= 300
  UNION ALL SELECT slug, -1, 1, {SEEDS}, 0, NULL FROM x)"""
ALL_SIGNALS = (ISSUES, REPO_HITS, ISSUE_HITS, EXEMPLARS, SIGNALS_OF)
SCANNED = ["repos", "issues", "exemplar_lines"]
oracle("union_signals", SCANNED, "SELECT full_name, rule_no, rank, kind, detail, url FROM sg", *ALL_SIGNALS)
ONCE = """sd AS (SELECT full_name, url, detail, min({'r': rule_no, 'n': rank, 'kind': kind}) AS p FROM sg GROUP BY full_name, url, detail),
sl AS (SELECT full_name, list({'p': p, 'url': url, 'detail': detail} ORDER BY p.r, p.n, url, detail, p.kind) AS sig FROM sd GROUP BY full_name),
sm AS (SELECT full_name, max(stars) AS stars, min_by(description, rule_no) FILTER (WHERE description IS NOT NULL) AS description,
  coalesce(max(CASE WHEN kind IN ('repo-search', 'exemplar') THEN {'r': rule_no, 'n': rank, 'u': url} END).u, '') AS html_url FROM sg GROUP BY full_name)"""
oracle("collect_signals", SCANNED, "SELECT full_name, stars, description, html_url, array_to_string(list_transform(sig, lambda s: concat(s.p.kind, '=', s.detail)), ';') AS signals FROM sl JOIN sm USING (full_name)", *ALL_SIGNALS, ONCE)
oracle("rank_candidates", SCANNED, "SELECT full_name, len(sig)::INTEGER AS n_signals, stars FROM sl JOIN sm USING (full_name) ORDER BY n_signals DESC, stars DESC, full_name LIMIT 500", *ALL_SIGNALS, ONCE)
oracle("text_evidence", ["stored"], f"SELECT repo_url, {text_points(SIGNALS)} AS evidence FROM a_stored")
RELEVANT = "(" + " + ".join(f"CASE WHEN {has_any('lower(' + title_of('s.detail') + ')', p)} THEN {n} ELSE 0 END" for n, p in rules.RELEVANCE) + ") > 0"
#: Stored projects have one pull request at most, so that their order needs no SQL.
PR_TEXT = f"array_to_string(list_transform(list_filter(sig, lambda s: s.kind = 'pull-request' AND {RELEVANT}), lambda s: concat({title_of('s.detail')}, '=', s.url)), ';')"
PROJECT_ROW = f"""pr AS (SELECT split_part(full_name, '/', -1) AS name, c.repo_url, c.description, c.stars, forks, open_issues, open_prs, CASE WHEN lower(ol) NOT IN {names([*rules.NOISE_LANGUAGES, 'rust'])} THEN ol END AS original_language,
{half_up('c.rust_percentage')} AS rust_percentage, conf AS confidence, array_to_string(list_transform(sig, lambda s: concat(s.kind, '=', s.detail, '=', s.url)), ';') AS signals, {PR_TEXT} AS rewrite_prs, {PR_TEXT} AS rewrite_pr,
NULL::DOUBLE AS unsafe_percentage, kind AS project_kind, origin AS named_origin, lines_added, lines_removed, rewrite_velocity, ai_assist_score, coalesce({AGENTS}, '') AS ai_agents, rewrite_duration_days, commit_count,
CASE WHEN strong THEN from_language END AS history_from_language, CASE WHEN strong THEN c.history_rust_before END AS history_rust_before, CASE WHEN strong THEN c.history_rust_after END AS history_rust_after, c.magnitude AS transition_magnitude,
CASE WHEN c.total_commits_analyzed > 0 THEN c.total_commits_analyzed END AS total_commits_analyzed, NULL::VARCHAR AS history_status, NULL::VARCHAR AS history_error, NULL::VARCHAR AS history_attempted_at, NULL::BIGINT AS history_attempts,
coalesce(sig[1].url, c.repo_url) AS source_url, '2025-01-01' AS first_detected, '2025-01-01' AS last_seen
FROM (SELECT *, coalesce(original_language, CASE WHEN strong THEN from_language END) AS ol, {confidence('kind')} AS conf FROM c5) c JOIN a_stored USING (repo_url))"""
oracle("project_row", ["stored", "origin_lines"], "SELECT * FROM pr", ORIGINS, CANDIDATES, _evidence(), PROJECT_ROW)
oracle("reclassify", ["stored", "origin_lines"], """SELECT pr.* REPLACE (s.unsafe_percentage AS unsafe_percentage, coalesce(pr.total_commits_analyzed, s.total_commits_analyzed) AS total_commits_analyzed, s.history_status AS history_status, s.history_error AS history_error,
  s.history_attempted_at AS history_attempted_at, s.history_attempts AS history_attempts, s.first_detected AS first_detected, s.last_seen AS last_seen)
FROM pr JOIN a_stored s USING (repo_url) WHERE pr.project_kind IN ('rewrite', 'replacement')""", ORIGINS, CANDIDATES, _evidence(), PROJECT_ROW)
oracle("score_confidence", ["stored", "origin_lines"], f"SELECT full_name, kind3 AS kind, {confidence('kind3')} AS confidence FROM (SELECT *, CASE length(full_name) % 3 WHEN 0 THEN 'rewrite' WHEN 1 THEN 'replacement' ELSE 'neither' END AS kind3 FROM c5) p", ORIGINS, CANDIDATES, _evidence())
oracle("select_migration_prs", SCANNED, f"""SELECT full_name, coalesce(urls, '') AS urls FROM sl LEFT JOIN (SELECT full_name, string_agg(url, ',' ORDER BY number, place) AS urls FROM (
  SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY number, place) AS rn FROM (
    SELECT full_name, url, min(number) AS number, min(place) AS place FROM (
      SELECT full_name, s.url AS url, coalesce(try_cast(regexp_extract(s.url, '/pull/([0-9]+)$', 1) AS BIGINT), 9223372036854775807) AS number, place
      FROM (SELECT full_name, unnest(sig) AS s, generate_subscripts(sig, 1) AS place FROM sl) u
      WHERE s.p.kind = 'pull-request' AND ({" + ".join(f"CASE WHEN {has_any('lower(' + title_of('s.detail') + ')', p)} THEN {n} ELSE 0 END" for n, p in rules.RELEVANCE)}) > 0) v
    GROUP BY full_name, url) w) x WHERE rn <= 5 GROUP BY full_name) y USING (full_name)""", *ALL_SIGNALS, ONCE)
oracle("source_link", ["stored"], f"""SELECT repo_url, coalesce(list_filter(sig, lambda s: s.kind = 'pull-request')[1].url, list_filter(sig, lambda s: s.kind = 'issue')[1].url, repo_url) AS link FROM (SELECT repo_url, {SIGNALS} AS sig FROM a_stored) s0""")

# Filters and joins
oracle("min_confidence_filter", ["stored"], "SELECT repo_url, confidence FROM a_stored WHERE confidence >= 0.15::DOUBLE")
LISTED = "project_kind <> 'neither' AND confidence > 0"
oracle("listing_filter", ["stored"], f"SELECT repo_url, project_kind, confidence FROM a_stored WHERE {LISTED}")
oracle("search_listing", ["stored"], "SELECT repo_url, description, original_language FROM a_stored WHERE contains(lower(concat_ws(' ', split_part(name, '/', 0), name, nullif(description, ''), original_language)), 'python')")
FLAGGED = f"p AS (SELECT s.*, x.slug IS NOT NULL AS exemplar FROM a_stored s LEFT JOIN x ON x.slug = {slug_of('repo_url')})"
WAITS = "CASE WHEN coalesce(history_status = 'ok', false) THEN {unmeasured} ELSE NOT ({given_up}) END"
UNMEASURED = "(unsafe_percentage IS NULL AND (original_language IS NULL OR rust_percentage >= 50) AND NOT exemplar)"
GIVEN_UP = "coalesce(history_status = 'failed' AND coalesce(history_attempts, 0) >= 3, false)"
PENDING = WAITS.format(unmeasured=UNMEASURED, given_up=GIVEN_UP)
oracle("backlog_pending", ["stored", "exemplar_lines"], f"SELECT repo_url, {PENDING} AS pending, {WAITS.format(unmeasured='false', given_up='false')} AS pending_retry FROM p", EXEMPLARS, FLAGGED)
oracle("star_cap_filter", ["stored"], "SELECT repo_url, stars FROM a_stored WHERE stars < 500")
FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(html_url, ''), lambda c: ascii(c)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
oracle("shard_filter", ["repos"], f"SELECT html_url FROM a_repos WHERE {FNV} % 5 = 2")
BARE = """b AS (SELECT full_name, '' AS html_url, CASE WHEN k % 2 = 0 THEN description END AS description, CASE WHEN k % 4 < 2 THEN stars ELSE 0 END AS stars FROM a_repos
UNION ALL SELECT concat(full_name, '-gone'), '', CASE WHEN k % 2 = 0 THEN 'kept' END, 0 FROM a_repos)"""
oracle("enrich_metadata", ["repos"], """SELECT b.full_name, CASE WHEN b.stars = 0 AND b.description IS NULL THEN r.html_url ELSE b.html_url END AS html_url, CASE WHEN b.stars = 0 AND b.description IS NULL THEN r.description ELSE b.description END AS description,
greatest(b.stars, coalesce(r.stars, 0)) AS stars, coalesce(forks, 0) AS forks, coalesce(open_issues, 0) AS open_issues FROM b LEFT JOIN a_repos r ON r.full_name = b.full_name WHERE r.full_name IS NOT NULL OR b.stars > 0 OR b.description IS NOT NULL""", BARE)
oracle("open_pr_counts", ["repos", "issues"], """SELECT full_name, coalesce(n, 0) AS open_prs, greatest(open_issues - coalesce(n, 0), 0) AS open_issues FROM a_repos
LEFT JOIN (SELECT full_name, count(*) AS n FROM i WHERE kind = 'pull-request' AND state = 'open' GROUP BY full_name) c USING (full_name)""", ISSUES)
MIX = f"""m AS (SELECT full_name, {half_up("t / total::DOUBLE * 100.0::DOUBLE")} AS rust_percentage, CASE WHEN displaced.bytes / total::DOUBLE * 100 >= 12 THEN displaced.lang END AS original_language, first.lang = 'Rust' AS rust_is_primary
FROM (SELECT full_name, sum(bytes) AS total, sum(CASE WHEN lang = 'Rust' THEN bytes ELSE 0 END) AS t, max({{'bytes': bytes, 'lang': lang}}) FILTER (WHERE lower(lang) NOT IN {names([*rules.NOISE_LANGUAGES, 'rust'])}) AS displaced,
  min({{'b': -bytes, 'lang': lang}}) AS first FROM a_languages GROUP BY full_name) s)"""
oracle("language_mix", ["languages"], "SELECT * FROM m", MIX)
oracle("attach_languages", ["repos", "languages"], "SELECT b.full_name, html_url, description, stars, coalesce(rust_percentage, 0) AS rust_percentage, original_language, coalesce(rust_is_primary, false) AS rust_is_primary FROM b LEFT JOIN m USING (full_name)", BARE, MIX)
oracle("preserve_first_seen", ["shard_1", "shard_2"], "SELECT b.repo_url, coalesce(a.first_detected, b.first_detected) AS first_detected, b.last_seen FROM a_shard_2 b LEFT JOIN a_shard_1 a USING (repo_url)")
oracle("flag_exemplars", ["stored", "exemplar_lines"], "SELECT repo_url, exemplar FROM p", EXEMPLARS, FLAGGED)
oracle("curated_origin_override", ["stored", "origin_lines"], f"SELECT repo_url, coalesce(label, named_origin) AS named_origin FROM a_stored LEFT JOIN o ON o.slug = {slug_of('repo_url')}", ORIGINS)
oracle("pending_exemplars", ["stored", "exemplar_lines"], f"SELECT slug FROM x WHERE slug NOT IN (SELECT {slug_of('repo_url')} FROM a_stored WHERE history_status = 'ok')", EXEMPLARS)
oracle("path_language_join", ["changes"], f"SELECT repo, lang, count(*) AS files, sum(added)::BIGINT AS added FROM (SELECT *, {language()} AS lang FROM a_changes WHERE contains(split_part(path, '/', -1), '.')) c WHERE lang IS NOT NULL GROUP BY repo, lang")

# History
LANG = f"lc AS (SELECT *, {language()} AS lang FROM a_changes)"
NET = """rn AS (SELECT repo, lang, commit_seq, file_seq, s - least(0, min(s) OVER w) AS net FROM (SELECT *, sum(added - removed) OVER (PARTITION BY repo, lang ORDER BY commit_seq, file_seq) AS s FROM lc WHERE lang IS NOT NULL) q
  WINDOW w AS (PARTITION BY repo, lang ORDER BY commit_seq, file_seq))"""
SAMPLES = """sp AS (SELECT repo, commit_seq, row_number() OVER (PARTITION BY repo ORDER BY commit_seq) - 1 AS sample_no FROM (SELECT repo, commit_seq, count(*) OVER (PARTITION BY repo) AS n FROM a_commits) c
  WHERE commit_seq % greatest(n // {POINTS}, 1) = 0 OR commit_seq = n - 1)""".replace("{POINTS}", str(rules.SAMPLE_POINTS))
ASOF = """co AS (SELECT repo, sample_no, commit_seq, lang, coalesce(net, 0)::BIGINT AS net FROM (SELECT g.repo, g.sample_no, g.commit_seq, g.lang,
  (SELECT max_by(net, {'c': r.commit_seq, 'f': r.file_seq}) FROM rn r WHERE r.repo = g.repo AND r.lang = g.lang AND r.commit_seq <= g.commit_seq) AS net
  FROM (SELECT sp.repo, sample_no, commit_seq, lang FROM sp JOIN (SELECT DISTINCT repo, lang FROM rn) l ON l.repo = sp.repo) g) h)"""
ASOF = """co AS (SELECT g.repo, g.sample_no, g.commit_seq, g.lang, coalesce(r.net, 0)::BIGINT AS net FROM (SELECT sp.repo, sample_no, commit_seq, lang FROM sp JOIN (SELECT DISTINCT repo, lang FROM rn) l ON l.repo = sp.repo) g
  ASOF LEFT JOIN (SELECT repo, lang, commit_seq, max_by(net, file_seq) AS net FROM rn GROUP BY repo, lang, commit_seq) r ON r.repo = g.repo AND r.lang = g.lang AND g.commit_seq >= r.commit_seq)"""
SERIES = """se AS (SELECT repo, sample_no, commit_seq, net_total, CASE WHEN net_total > 0 THEN t / net_total::DOUBLE * 100.0::DOUBLE ELSE 0::DOUBLE END AS share FROM (SELECT sp.repo, sp.sample_no, sp.commit_seq, coalesce(sum(net), 0)::BIGINT AS net_total,
  coalesce(sum(CASE WHEN lang = 'Rust' THEN net ELSE 0 END), 0)::BIGINT AS t FROM sp LEFT JOIN co ON co.repo = sp.repo AND co.sample_no = sp.sample_no GROUP BY ALL) s)"""
SEGMENTS = """sz AS (SELECT repo, count(*) AS n, greatest(ceil(count(*) * 0.2::DOUBLE), 1) AS e FROM sp GROUP BY repo),
sh AS (SELECT co.*, CASE WHEN sum(net) OVER (PARTITION BY repo, sample_no) > 0 THEN net / (sum(net) OVER (PARTITION BY repo, sample_no))::DOUBLE * 100.0::DOUBLE ELSE 0::DOUBLE END AS share FROM co),
ss AS (SELECT sh.repo, lang, sum(CASE WHEN sample_no < e THEN share ELSE 0 END) / max(e) AS before, sum(CASE WHEN sample_no >= n - e THEN share ELSE 0 END) / max(e) AS after FROM sh JOIN sz ON sz.repo = sh.repo GROUP BY sh.repo, lang)"""
RISE = """ri AS (SELECT repo, slope, rise_start, rise_end FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY slope DESC, sample_no) AS rn FROM (SELECT repo, sample_no, commit_seq AS rise_end,
  lag(commit_seq) OVER (PARTITION BY repo ORDER BY sample_no) AS rise_start, share - lag(share) OVER (PARTITION BY repo ORDER BY sample_no) AS slope FROM se) a WHERE slope > 0) b WHERE rn = 1)"""
WINDOW = """wi AS (SELECT se.repo, least(coalesce(min(commit_seq) FILTER (WHERE commit_seq <= rise_start AND share < 25), max(rise_start)), max(rise_start)) AS start_seq,
  greatest(coalesce(max(commit_seq) FILTER (WHERE commit_seq >= rise_end AND share > 50), max(rise_end)), max(rise_end)) AS end_seq FROM se JOIN ri ON ri.repo = se.repo WHERE slope >= 5 GROUP BY se.repo)"""
CHURN = "ch AS (SELECT repo, commit_seq, sum(CASE WHEN lang = 'Rust' THEN added ELSE removed END)::BIGINT AS churn FROM lc WHERE lang IS NOT NULL GROUP BY repo, commit_seq HAVING churn > 0)"
INSIDE = """wc AS (SELECT c.*, coalesce(l.added, 0)::BIGINT AS added, coalesce(l.removed, 0)::BIGINT AS removed FROM a_commits c JOIN (SELECT repo FROM sp GROUP BY repo HAVING count(*) > 1) s ON s.repo = c.repo LEFT JOIN wi ON wi.repo = c.repo
  LEFT JOIN ch ON ch.repo = c.repo AND ch.commit_seq = c.commit_seq LEFT JOIN (SELECT repo, commit_seq, sum(added) AS added, sum(removed) AS removed FROM a_changes GROUP BY ALL) l ON l.repo = c.repo AND l.commit_seq = c.commit_seq
  WHERE CASE WHEN wi.repo IS NOT NULL THEN c.commit_seq BETWEEN start_seq AND end_seq ELSE churn IS NOT NULL END)"""
HISTORY, BOTH = (LANG, NET, SAMPLES, ASOF, SERIES), ["commits", "changes"]
oracle("running_net_lines", ["changes"], "SELECT repo, lang, commit_seq, file_seq, net::BIGINT AS net FROM rn", LANG, NET)
oracle("composition_samples", ["commits"], "SELECT repo, sample_no, commit_seq FROM sp", SAMPLES)
oracle("composition_asof", BOTH, "SELECT * FROM co", *HISTORY[:4])
oracle("rust_share_series", BOTH, f"SELECT repo, sample_no, commit_seq, net_total, {half_up('share', 4)} AS share FROM se", *HISTORY)
oracle("segment_shares", BOTH, f"SELECT repo, lang, {half_up('before', 4)} AS before, {half_up('after', 4)} AS after FROM ss", *HISTORY, SEGMENTS)
TRANSITION = f"""tr AS (SELECT t.repo, coalesce(b, 0) AS b, coalesce(a, 0) AS a, d, total_commits, late_net FROM (SELECT repo, count(*) AS total_commits FROM a_commits GROUP BY repo) t
LEFT JOIN (SELECT repo, max(before) FILTER (WHERE lang = 'Rust') AS b, max(after) FILTER (WHERE lang = 'Rust') AS a, (min({{'s': -before, 'lang': lang}}) FILTER (WHERE lower(lang) <> 'rust' AND before >= 15)).lang AS d FROM ss GROUP BY repo) q ON q.repo = t.repo
LEFT JOIN (SELECT repo, max_by(net_total, sample_no) AS late_net FROM se GROUP BY repo) l ON l.repo = t.repo),
tm AS (SELECT *, a > b + 5 AS rising, CASE WHEN a > b + 5 THEN a - b ELSE 0 END AS m FROM tr),
tf AS (SELECT *, CASE WHEN rising AND m >= 10 AND b <= 35 AND lower(d) NOT IN {names(rules.NOISE_LANGUAGES)} THEN d END AS from_language FROM tm)"""
oracle("language_transition", BOTH, f"""SELECT repo, from_language, {half_up('b', 1)} AS rust_before, {half_up('a', 1)} AS rust_after, CASE WHEN rising THEN {half_up('m', 1)} END AS magnitude, total_commits,
rising AND m >= 25 AND b <= 35 AND a >= 40 AND from_language IS NOT NULL AND late_net >= 500 AS strong FROM tf""", *HISTORY, SEGMENTS, TRANSITION)
oracle("steepest_rise", BOTH, f"SELECT repo, {half_up('slope', 4)} AS slope, rise_start, rise_end FROM ri", *HISTORY, RISE)
oracle("transition_window", BOTH, "SELECT * FROM wi", *HISTORY, RISE, WINDOW)
oracle("transition_churn", ["changes"], "SELECT * FROM ch", LANG, CHURN)
TRANSITIONAL = (*HISTORY, RISE, WINDOW, CHURN, INSIDE)
oracle("window_totals", BOTH, f"""SELECT repo, lines_added, lines_removed, commit_count, {half_up('(lines_added + lines_removed) / days::DOUBLE')} AS velocity, days FROM (SELECT repo, sum(added)::BIGINT AS lines_added, sum(removed)::BIGINT AS lines_removed,
count(*) AS commit_count, greatest((max(ts) - min(ts)) // 86400, 1)::BIGINT AS days FROM wc GROUP BY repo) w""", *TRANSITIONAL)
oracle("ai_agents", ["commits"], f"SELECT repo, string_agg(agent, ',' ORDER BY agent) AS agents FROM (SELECT DISTINCT repo, {agent('trailer')} AS agent FROM a_commits) a WHERE agent IS NOT NULL GROUP BY repo")
BURST = "CASE WHEN burst >= 10 THEN 0.25::DOUBLE WHEN burst >= 5 THEN 0.15::DOUBLE WHEN burst >= 3 THEN 0.08::DOUBLE ELSE 0::DOUBLE END"
BURSTS = "(SELECT repo, max(c) AS burst FROM (SELECT repo, count(*) OVER (PARTITION BY repo ORDER BY ts RANGE BETWEEN CURRENT ROW AND 172800 FOLLOWING) AS c FROM {}) b GROUP BY repo)"
oracle("commit_burst", ["commits"], f"SELECT repo, burst, {BURST} AS burst_score FROM {BURSTS.format('a_commits')} b")
oracle("ai_assist_score", BOTH, f"""SELECT s.repo, {half_up(f'least(CASE WHEN mean > 500 THEN 0.30::DOUBLE WHEN mean > 200 THEN 0.15::DOUBLE ELSE 0::DOUBLE END + templated * 0.25::DOUBLE + big * 0.25::DOUBLE + {BURST} + CASE WHEN agent THEN 0.20::DOUBLE ELSE 0::DOUBLE END, 1.0::DOUBLE)')} AS score
FROM (SELECT repo, sum(added + removed) / count(*)::DOUBLE AS mean, count(*) FILTER (WHERE {has_any('lower(subject)', rules.TEMPLATED)}) / count(*)::DOUBLE AS templated, count(*) FILTER (WHERE added > 2000) / count(*)::DOUBLE AS big,
  coalesce(bool_or({agent('trailer')} IS NOT NULL), false) AS agent FROM wc GROUP BY repo) s JOIN {BURSTS.format('wc')} b ON b.repo = s.repo""", *TRANSITIONAL)

# The stored table
SHOWN = ["stars", "confidence", "project_kind", "original_language", "unsafe_percentage", "lines_added", "history_status", "history_attempted_at", "history_attempts", "first_detected", "last_seen", "transition_magnitude", "history_from_language"]
KEPT = ["unsafe_percentage", "lines_added", "history_status", "history_attempted_at", "history_attempts"]


def upsert(old: str, new: str) -> str:
    def value(c: str) -> str:
        if c in KEPT:
            return f"coalesce(n.{c}, o.{c}) AS {c}"
        if c == "first_detected":
            return f"CASE WHEN o.repo_url IS NOT NULL THEN o.{c} ELSE n.{c} END AS {c}"
        return f"CASE WHEN n.repo_url IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}"

    agents = "CASE WHEN n.repo_url IS NULL OR (o.repo_url IS NOT NULL AND n.ai_agents = '[]') THEN o.ai_agents ELSE n.ai_agents END"
    return f"""SELECT coalesce(n.repo_url, o.repo_url) AS repo_url, {', '.join(map(value, SHOWN))}, {AGENTS.replace('ai_agents', agents)} AS agents FROM {old} o FULL JOIN {new} n ON n.repo_url = o.repo_url"""


oracle("upsert_projects", ["stored", "shard_2"], upsert("a_stored", "a_shard_2"))
oracle("merge_upsert_rules", ["shard_1", "shard_2"], upsert("a_shard_1", "a_shard_2"))
oracle("merge_shards", ["stored", "shard_1", "shard_2"], upsert("a_stored", "best"), """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_url ORDER BY CASE history_status WHEN 'ok' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END DESC,
  coalesce(history_attempted_at, '') DESC, source_no) AS rn FROM (SELECT *, 0 AS source_no FROM a_stored UNION ALL SELECT *, 1 FROM a_shard_1 UNION ALL SELECT *, 2 FROM a_shard_2) u) v WHERE rn = 1)""")
RANKED = "{'s': CASE history_status WHEN 'ok' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END, 'at': coalesce(history_attempted_at, '')} AS r"
oracle("merged_counts", ["stored", "shard_1", "shard_2"], f"""SELECT s.source_no, count(*) FILTER (WHERE s.r > (SELECT max(e.r) FROM a e WHERE e.repo_url = s.repo_url AND e.source_no < s.source_no)) AS merged FROM a s WHERE s.source_no > 0 GROUP BY s.source_no""",
  f"a AS (SELECT repo_url, 0 AS source_no, {RANKED} FROM a_stored UNION ALL SELECT repo_url, 1, {RANKED} FROM a_shard_1 UNION ALL SELECT repo_url, 2, {RANKED} FROM a_shard_2)")
oracle("kind_counts", ["stored"], "SELECT count(*) AS total, count(*) FILTER (WHERE project_kind = 'rewrite') AS rewrites, count(*) FILTER (WHERE project_kind = 'replacement') AS replacements, count(*) FILTER (WHERE project_kind = 'neither') AS dropped FROM a_stored")
oracle("backlog_counts", ["stored", "exemplar_lines"], f"""SELECT count(*) FILTER (WHERE w) AS pending, count(*) FILTER (WHERE stars < 700 AND NOT w AND coalesce(history_status = 'ok', false)) AS skipped, count(*) FILTER (WHERE stars < 700 AND NOT w AND NOT coalesce(history_status = 'ok', false)) AS dead_lettered,
count(*) FILTER (WHERE stars >= 700) AS star_capped, count(*) FILTER (WHERE history_status IS NULL OR (history_status = 'failed' AND coalesce(history_attempts, 0) < 3) OR (history_status = 'ok' AND unsafe_percentage IS NULL AND (original_language IS NULL OR rust_percentage >= 50))) AS watchdog_pending
FROM (SELECT *, {PENDING} AS w FROM p) q""", EXEMPLARS, FLAGGED)
oracle("mark_history_attempt", ["repos", "stored"], """SELECT repo_url, CASE k % 3 WHEN 0 THEN history_status WHEN 1 THEN 'ok' ELSE 'failed' END AS history_status, CASE k % 3 WHEN 0 THEN history_error WHEN 2 THEN 'lost' END AS history_error,
CASE k % 3 WHEN 0 THEN history_attempted_at ELSE '2025-01-01' END AS history_attempted_at, CASE k % 3 WHEN 0 THEN history_attempts WHEN 1 THEN 0 ELSE coalesce(history_attempts, 0) + 1 END AS history_attempts FROM a_stored JOIN a_repos ON html_url = repo_url""")

# Orders and pages
ORDER = "exemplar DESC, project_kind = 'rewrite' DESC, confidence DESC, stars DESC, repo_url"
BACKFILL = "exemplar DESC, stars DESC, floor((1.0::DOUBLE - least(confidence, 1.0::DOUBLE)) * 1000000.0::DOUBLE), repo_url"
oracle("backfill_priority", ["stored", "exemplar_lines"], f"SELECT repo_url, exemplar, stars, confidence FROM p ORDER BY {BACKFILL}", EXEMPLARS, FLAGGED)
oracle("backfill_batch", ["stored", "exemplar_lines"], f"SELECT repo_url, exemplar, stars, confidence FROM p WHERE {PENDING} ORDER BY {BACKFILL} LIMIT 25", EXEMPLARS, FLAGGED)
oracle("listing_order", ["stored", "exemplar_lines", "origin_lines"], f"SELECT repo_url, exemplar, project_kind, confidence, stars, coalesce(label, named_origin) AS named_origin FROM p LEFT JOIN o ON o.slug = {slug_of('repo_url')} WHERE {LISTED} ORDER BY {ORDER}", EXEMPLARS, ORIGINS, FLAGGED)
SORTS = {"rewrites": "exemplar DESC, project_kind = 'rewrite' DESC, confidence DESC", "confidence": "exemplar DESC, confidence DESC", "stars": "stars DESC", "recent": "first_detected DESC"}
oracle("listing_sorts", ["stored", "exemplar_lines"], " UNION ALL ".join(f"(SELECT '{n}' AS sort, repo_url FROM p WHERE {LISTED} ORDER BY {o}, {ORDER} LIMIT 36 OFFSET 36)" for n, o in SORTS.items()), EXEMPLARS, FLAGGED)
oracle("listing_page", ["stored", "exemplar_lines"], f"SELECT repo_url FROM (SELECT *, row_number() OVER (ORDER BY {ORDER}) - 1 AS n, count(*) OVER () AS total FROM p WHERE {LISTED}) q WHERE n // 24 = (total - 1) // 24", EXEMPLARS, FLAGGED)

#: Columns that a published line may lack, and when it has them; all others are always there.
SOMETIMES = {c: f"{c} IS NOT NULL" for c in (
    "named_origin", "lines_added", "lines_removed", "rewrite_velocity", "ai_assist_score", "rewrite_duration_days", "commit_count", "history_from_language", "history_rust_before", "history_rust_after",
    "transition_magnitude", "total_commits_analyzed", "history_status", "history_error", "history_attempted_at", "history_attempts")}
SOMETIMES |= {"rewrite_prs": "rewrite_pr_title IS NOT NULL", "rewrite_pr": "rewrite_pr_title IS NOT NULL", "ai_agents": f"coalesce({AGENTS}, '') <> ''"}
ALWAYS = ["name", "repo_url", "description", "stars", "forks", "open_issues", "open_prs", "original_language", "rust_percentage", "confidence", "signals", "unsafe_percentage", "project_kind", "source_url", "first_detected", "last_seen", "exemplar"]
KEYS = ", ".join([*map(quoted, ALWAYS), *(f"CASE WHEN {when} THEN {quoted(c)} END" for c, when in SOMETIMES.items())])
oracle("publish_listing", ["stored", "exemplar_lines"], f"""SELECT row_number() OVER (ORDER BY {ORDER}) - 1 AS rank, array_to_string(list_sort(list_filter([{KEYS}], lambda k: k IS NOT NULL)), ',') AS keys,
repo_url, description, confidence, stars, exemplar, unsafe_percentage, rewrite_pr_title AS pr_title, coalesce({AGENTS}, '') AS agents FROM p WHERE {LISTED}""", EXEMPLARS, FLAGGED)


def history_analysis(points: int = rules.SAMPLE_POINTS) -> str:
    """Every repository's history, from the queries of its parts."""
    parts = {n: ORACLES[n].replace(f"// {rules.SAMPLE_POINTS}", f"// {points}") for n in ("language_transition", "window_totals", "ai_assist_score", "ai_agents")}
    return f"""SELECT t.*, w.lines_added, w.lines_removed, w.commit_count, w.velocity, w.days, s.score, coalesce(g.agents, '') AS agents FROM ({parts["language_transition"]}) t
LEFT JOIN ({parts["window_totals"]}) w ON w.repo = t.repo LEFT JOIN ({parts["ai_assist_score"]}) s ON s.repo = t.repo LEFT JOIN ({parts["ai_agents"]}) g ON g.repo = t.repo"""


ORACLES["history_analysis"] = history_analysis()


def scanned(found: str, repos: str, issues: str, languages: str, analysis: str | None) -> tuple[str, ...]:
    """CTEs up to c5 for candidates: ``found`` (full_name, html_url, description, stars, sig), with facts and histories."""
    known = "r.full_name IS NOT NULL"
    bare = "(f.stars = 0 AND f.description IS NULL)"
    history = analysis or "SELECT NULL::VARCHAR AS repo, NULL::VARCHAR AS from_language, NULL::DOUBLE AS rust_before, NULL::DOUBLE AS rust_after, NULL::DOUBLE AS magnitude, NULL::BIGINT AS total_commits, NULL::BOOLEAN AS strong, NULL::BIGINT AS lines_added, NULL::BIGINT AS lines_removed, NULL::BIGINT AS commit_count, NULL::DOUBLE AS velocity, NULL::BIGINT AS days, NULL::DOUBLE AS score, NULL::VARCHAR AS agents"
    return (
        f"fo AS ({found})",
        f"""mx AS (SELECT full_name, CASE WHEN total > 0 THEN t / total::DOUBLE * 100.0::DOUBLE ELSE 0 END AS rust_percentage, CASE WHEN displaced.bytes / total::DOUBLE * 100 >= 12 THEN displaced.lang END AS original_language, first.lang = 'Rust' AS rust_is_primary
FROM (SELECT full_name, sum(bytes) AS total, sum(CASE WHEN lang = 'Rust' THEN bytes ELSE 0 END) AS t, max({{'bytes': bytes, 'lang': lang}}) FILTER (WHERE lower(lang) NOT IN {names([*rules.NOISE_LANGUAGES, 'rust'])}) AS displaced, min({{'b': -bytes, 'lang': lang}}) AS first FROM ({languages}) l GROUP BY full_name) s)""",
        f"ha AS MATERIALIZED ({history})",
        f"hm AS (SELECT {slug_of('full_name')} AS own_slug, ha.* FROM a_repos JOIN ha ON ha.repo = concat('org/repo', k::VARCHAR))",
        f"""c0 AS (SELECT f.full_name, {slug_of("f.full_name")} AS key_slug, CASE WHEN {bare} AND {known} THEN r.html_url WHEN f.html_url = '' THEN concat('https://github.com/', f.full_name) ELSE f.html_url END AS repo_url,
  CASE WHEN {bare} AND {known} THEN r.description ELSE f.description END AS description, greatest(f.stars, coalesce(r.stars, 0)) AS stars, coalesce(r.forks, 0) AS forks, greatest(coalesce(r.open_issues, 0) - coalesce(n, 0), 0) AS open_issues, coalesce(n, 0) AS open_prs, sig,
  coalesce(mx.rust_percentage, 0) AS rust_percentage, mx.original_language, coalesce(rust_is_primary, false) AS is_primary, h.from_language, h.magnitude, h.rust_before AS history_rust_before, h.rust_after AS history_rust_after, h.total_commits AS total_commits_analyzed, coalesce(h.strong, false) AS strong,
  h.lines_added, h.lines_removed, h.velocity AS rewrite_velocity, h.score AS ai_assist_score, coalesce(h.agents, '') AS ai_agents, h.days AS rewrite_duration_days, h.commit_count
FROM fo f LEFT JOIN ({repos}) r ON r.full_name = f.full_name LEFT JOIN (SELECT full_name, count(*) AS n FROM ({issues}) i WHERE kind = 'pull-request' AND state = 'open' GROUP BY full_name) q ON q.full_name = f.full_name
LEFT JOIN mx ON mx.full_name = f.full_name LEFT JOIN hm h ON h.own_slug = {slug_of("f.full_name")} WHERE {known} OR NOT {bare})""",
        ORIGINATED,
        _evidence(),
    )


FOUND = "SELECT full_name, html_url, description, stars, list_transform(sig, lambda s: {'kind': s.p.kind, 'detail': s.detail, 'url': s.url}) AS sig FROM sl JOIN sm USING (full_name) ORDER BY len(sig) DESC, stars DESC, full_name LIMIT 500"
FACTS = ("SELECT * FROM a_repos", "SELECT * FROM i", "SELECT * FROM a_languages")
ORIGINAL = f"CASE WHEN lower(coalesce(original_language, CASE WHEN strong THEN from_language END)) NOT IN {names([*rules.NOISE_LANGUAGES, 'rust'])} THEN coalesce(original_language, CASE WHEN strong THEN from_language END) END"
SCANS = ["repos", "issues", "languages", "exemplar_lines", "origin_lines"]
oracle("scan", SCANS, f"""SELECT * FROM (SELECT split_part(full_name, '/', -1) AS name, repo_url, stars, open_issues, open_prs, {ORIGINAL} AS original_language, {half_up('rust_percentage')} AS rust_percentage, {confidence('kind')} AS confidence, kind AS project_kind, origin AS named_origin,
len(sig)::INTEGER AS n_signals FROM c5) z WHERE confidence >= 0.15::DOUBLE""", *ALL_SIGNALS, ONCE, ORIGINS, *scanned(FOUND, *FACTS, None))

BY_KIND = [f"list_filter(sig, lambda s: s.kind = '{kind}')[1].url" for kind in ("repo-search", "pull-request", "issue")]


def project_of(prs: str, done: bool) -> str:
    """All columns of a stored project from c5 of a scan."""
    strong = {c: f"CASE WHEN strong THEN {x} END AS {c}" for c, x in (("history_from_language", "from_language"), ("history_rust_before", "history_rust_before"), ("history_rust_after", "history_rust_after"))}
    ok = "total_commits_analyzed > 0"
    status = (f"CASE WHEN {ok} THEN 'ok' END", f"CASE WHEN {ok} THEN '2025-01-01' END", f"CASE WHEN {ok} THEN 0::BIGINT END") if done else ("NULL::VARCHAR", "NULL::VARCHAR", "NULL::BIGINT")
    return f"""SELECT split_part(full_name, '/', -1) AS name, z.repo_url, z.description, z.stars, z.forks, z.open_issues, z.open_prs, {ORIGINAL} AS original_language, {half_up('rust_percentage')} AS rust_percentage, conf AS confidence,
array_to_string(list_transform(sig, lambda s: concat(s.kind, '=', s.detail, '=', s.url)), ';') AS signals, coalesce(prs, '') AS rewrite_prs, coalesce(string_split(prs, ';')[1], '') AS rewrite_pr, NULL::DOUBLE AS unsafe_percentage, kind AS project_kind, origin AS named_origin,
lines_added, lines_removed, rewrite_velocity, ai_assist_score, ai_agents, rewrite_duration_days, commit_count, {", ".join(strong.values())}, magnitude AS transition_magnitude, CASE WHEN {ok} THEN total_commits_analyzed END AS total_commits_analyzed,
{status[0]} AS history_status, NULL::VARCHAR AS history_error, {status[1]} AS history_attempted_at, {status[2]} AS history_attempts, coalesce({", ".join(BY_KIND)}, sig[1].url, z.repo_url) AS source_url, coalesce(s.first_detected, '2025-01-01') AS first_detected, '2025-01-01' AS last_seen
FROM (SELECT *, {confidence('kind')} AS conf FROM c5) z LEFT JOIN (SELECT repo_url, first_detected FROM a_stored) s ON s.repo_url = z.repo_url LEFT JOIN ({prs}) p USING (full_name)"""


PRS = f"""SELECT full_name, string_agg(concat(title, '=', url), ';' ORDER BY number, place) AS prs FROM (
  SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY number, place) AS rn FROM (
    SELECT full_name, url, min(number) AS number, min(place) AS place, arg_min(title, {{'n': number, 'p': place}}) AS title FROM (
      SELECT full_name, s.url AS url, {title_of('s.detail')} AS title, coalesce(try_cast(regexp_extract(s.url, '/pull/([0-9]+)$', 1) AS BIGINT), 9223372036854775807) AS number, place
      FROM (SELECT full_name, unnest(sig) AS s, generate_subscripts(sig, 1) AS place FROM fo) u WHERE s.kind = 'pull-request' AND {RELEVANT}) v
    GROUP BY full_name, url) w) x WHERE rn <= 5 GROUP BY full_name"""
HISTORIES = [*SCANS, "stored", "commits", "changes"]
oracle("scan_with_histories", HISTORIES, project_of(PRS, False) + " WHERE conf >= 0.15::DOUBLE", *ALL_SIGNALS, ONCE, ORIGINS, *scanned(FOUND, *FACTS, history_analysis()))
LOWER = tuple(f"SELECT * REPLACE (lower(full_name) AS full_name) FROM ({f}) w" for f in FACTS)
PENDING_EXEMPLARS = f"""SELECT slug AS full_name, concat('https://github.com/', slug) AS html_url, NULL::VARCHAR AS description, 0::BIGINT AS stars, [{{'kind': 'exemplar', 'detail': 'curated exemplar rewrite (priority target)', 'url': concat('https://github.com/', slug)}}] AS sig
FROM x WHERE slug NOT IN (SELECT {slug_of('repo_url')} FROM a_stored WHERE history_status = 'ok')"""
oracle("scan_exemplars", HISTORIES, project_of("SELECT NULL::VARCHAR AS full_name, NULL::VARCHAR AS prs", True), ISSUES, EXEMPLARS, ORIGINS, *scanned(PENDING_EXEMPLARS, *LOWER, history_analysis(rules.EXEMPLAR_SAMPLE_POINTS)))
