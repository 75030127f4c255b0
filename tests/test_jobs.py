"""The jobs as a user runs them: curated projects through the table, candidates cut before their histories are analysed."""

from langshift import rules
from langshift.jobs import workflows
from langshift.operators import history
from langshift.sources import readers, tables
from tests.test_domain import projects

REPO = "full_name string, html_url string, description string, readme string, language string, stars bigint, forks bigint, open_issues bigint"
ISSUE = "full_name string, kind string, title string, url string, state string"


def listings(spark):
    repos = spark.createDataFrame([("Acme/Tool", "https://github.com/Acme/Tool", "Rust port of yjs", "", "Rust", 50, 3, 9), ("Other/Thing", "https://github.com/Other/Thing", "notes", "", "C", 5, 0, 0)], REPO)
    issues = spark.createDataFrame([("Acme/Tool", "pull-request", "x", "u1", "open"), ("Acme/Tool", "pull-request", "y", "u2", "closed")], ISSUE)
    languages = spark.createDataFrame([("Acme/Tool", "Rust", 80), ("Acme/Tool", "C", 20), ("Other/Thing", "C", 5)], "full_name string, lang string, bytes bigint")
    return repos, issues, languages


def logs(spark, repo, n=60):
    """A history that turns from C to Rust, under the repository's slug."""
    commits = [(repo, k, 1_600_000_000 + k * 86_400, f"port module {k}", ["Cursor Agent <cursoragent@cursor.com>"] if k == 5 else []) for k in range(n)]
    changes = [(repo, k, 0, "src/a.c" if k < n // 2 else "src/a.rs", 100, 0) for k in range(n)] + [(repo, k, 1, "src/a.c", 0, 100) for k in range(n // 2, n)]
    return commits, changes


def history_tables(spark, *repos):
    found = [logs(spark, r) for r in repos]
    commits = spark.createDataFrame(sum((c for c, _ in found), []), "repo string, commit_seq bigint, ts bigint, subject string, coauthors array<string>")
    changes = spark.createDataFrame(sum((c for _, c in found), []), "repo string, commit_seq bigint, file_seq bigint, path string, added bigint, removed bigint")
    return commits, changes


def test_curated_projects_go_into_the_table(spark, tmp_path):
    root = f"{tmp_path}/root"
    exemplars = spark.createDataFrame([("acme/tool", 1), ("nobody/nothing", 2), ("other/thing", 3)], "slug string, place int")
    origins = spark.createDataFrame([], "slug string, label string")
    commits, changes = history_tables(spark, "acme/tool", "not/asked")
    workflows.upsert_projects(projects(spark, [{"repo_url": "https://github.com/Acme/Tool", "first_detected": "long ago", "history_status": "failed", "history_attempts": 2}, {"repo_url": "https://github.com/Other/Thing", "history_status": "ok"}]), root)

    def run(**options):
        found = workflows.scan_exemplars(exemplars, tables.current(spark, root), *listings(spark), origins, "now", commits=commits, changes=changes, **options)
        workflows.upsert_projects(found, root)
        return {r.repo_url: r for r in tables.current(spark, root).collect()}

    table = run()
    tool = table["https://github.com/Acme/Tool"]
    assert set(table) == {"https://github.com/Acme/Tool", "https://github.com/Other/Thing"}  # unknown ones are left out
    assert (tool.first_detected, tool.last_seen, tool.history_status, tool.history_attempted_at, tool.history_attempts, tool.total_commits_analyzed) == ("long ago", "now", "ok", "now", 0, 60)
    assert (tool.stars, tool.forks, tool.open_prs, tool.open_issues, tool.rust_percentage, tool.description) == (50, 3, 1, 8, 80.0, "Rust port of yjs")
    assert (tool.history_from_language, tool.original_language, tool.name) == ("C", "C", "tool") and tool.ai_agents == ["Cursor"] and tool.lines_added > 0
    assert [s.kind for s in tool.signals] == ["exemplar"] and tool.confidence > 0
    assert table["https://github.com/Other/Thing"].last_seen == "l"  # its history is done
    assert workflows.scan_exemplars(exemplars, tables.current(spark, root), *listings(spark), origins, "later", commits=commits, changes=changes).count() == 0
    table = run(force=True)
    other = table["https://github.com/Other/Thing"]
    # No floor of confidence, and without commits the stored status stays.
    assert other.last_seen == "now" and other.confidence < rules.MIN_CONFIDENCE and other.history_status == "ok" and other.total_commits_analyzed is None


def test_curated_projects_are_sampled_more_finely(spark, monkeypatch):
    asked = []
    analyse = history.analyse
    monkeypatch.setattr(history, "analyse", lambda commits, changes, points: asked.append((points, {r.repo for r in commits.select("repo").distinct().collect()}, {r.repo for r in changes.select("repo").distinct().collect()})) or analyse(commits, changes, points))
    exemplars = spark.createDataFrame([("acme/tool", 1)], "slug string, place int")
    origins = spark.createDataFrame([], "slug string, label string")
    commits, changes = history_tables(spark, "acme/tool", "not/asked")
    workflows.scan_exemplars(exemplars, None, *listings(spark), origins, "now", commits=commits, changes=changes)
    found = workflows.scan(*listings(spark), exemplars.where("false"), origins, "now", commits=commits, changes=changes).collect()
    # Only the candidates' commits and changes are analysed.
    assert asked == [(1200, {"acme/tool"}, {"acme/tool"}), (400, {"acme/tool"}, {"acme/tool"})]
    assert [(r.repo_url, r.total_commits_analyzed, r.history_from_language) for r in found] == [("https://github.com/Acme/Tool", 60, "C")]


def test_a_scan_keeps_when_a_project_was_first_seen(spark):
    origins = spark.createDataFrame([], "slug string, label string")
    none = spark.createDataFrame([], "slug string, place int")
    stored = projects(spark, [{"repo_url": "https://github.com/Acme/Tool", "first_detected": "then"}])
    found = workflows.scan(*listings(spark), none, origins, "now", stored=stored).collect()
    assert [(r.repo_url, r.first_detected, r.last_seen) for r in found] == [("https://github.com/Acme/Tool", "then", "now")]
    plain = workflows.scan(*listings(spark), none, origins, "now")
    assert plain.columns == list(readers.PROJECT) and plain.first().history_from_language is None
