"""The reference's operators as registered queries, each beside its independent SQL.

Every query runs over whole tables. Requests are ``pr_record`` without second deliveries;
later commits are ``commits``; paths of later commits come from the stored signals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from changelode.functions import paths, refs
from changelode.functions.times import exact_time, parse_time
from changelode.operators import admission, asof, baseline, correlate, diffs, keys, matching, merging, ranking, records, relations, reports, rules
from changelode.sources import sinks
from changelode.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# ----------------------------------------------------------- shared SQL


class Sql:
    """Patterns of the oracles, written for RE2 apart from those of the functions they check."""

    FIXES_SHA = r"""(?i)(?:fixed-by|fixed\s+by|fixes(?:\s+(?:commit|in))?):\s*[\"']?([a-f0-9]{6,40})[\"']?"""
    FIXES_PR = r"(?i)(?:closes|resolves|reverts|fixes|fixed-by)\s*:?\s*#(\d+)\b"
    REVERT_COMMIT = r"""(?i)(?:(?:this\s+)?reverts\s+commit|revert(?:ed)?\s+commit)\s+[\"']?([a-f0-9]{6,40})[\"']?"""
    REVERT_SUBJECT = r'(?i)revert\s+"(.*)"'
    REGRESSION = (
        r"(?i)(?:regression\s+introduced\s+in|regression\s+caused\s+by|regression\s+in|regression|broken\s+by|introduced\s+(?:in|by)|caused\s+by|fault\s+in|broke\s+in)"
        r"\s+(?:commit\s+([a-f0-9]{6,40})|#(\d+)|([a-f0-9]{6,40}))"
    )
    FIX_WORDS = r"(?i)\b(?:fix(?:es|ed)?|crash|leak|race|panic|null|segfault|deadlock|regression|memory corruption|use-after-free)\b"
    CITATION = r"fix|revert|regression|broken|caused|close|resolve"
    MERGE_SUBJECT = r"^Merge pull request #(\d+)"
    CVE = r"(?i)\bcve-\d{4}-\d{4,7}\b"
    NUMBER_REF = r"(?:^|[^\w/])#(\d+)\b"


PR = """pr AS (SELECT record_id, original.repository AS repository, original.number AS number, original.title AS title, original.author AS author, original.body AS body, original.merged_at AS merged_at,
 original.head_sha AS head_sha, original.merge_commit_sha AS merge_commit_sha, original.commit_shas AS commit_shas, original.changed_files AS changed_files, original.changed_functions AS changed_functions,
 original.changed_function_locations AS locations, original.commit_messages AS commit_messages, original.labels AS labels, stateful, retrospective, provenance
 FROM (SELECT DISTINCT ON (record_id) * FROM pr_record WHERE original IS NOT NULL))"""
CM = """cm AS (SELECT repository, sha, arg_min(author_date, coalesce(log_idx, 4611686018427387904)) AS author_date, arg_min(subject, coalesce(log_idx, 4611686018427387904)) AS subject, coalesce(len(arg_min(parents, coalesce(log_idx, 4611686018427387904))) > 1, false) AS merge,
 arg_min(full_message, coalesce(log_idx, 4611686018427387904)) AS full_message FROM commits WHERE sha IS NOT NULL AND repository IS NOT NULL GROUP BY ALL)"""
CITING = f"citing AS (SELECT * FROM cm WHERE regexp_matches(lower(full_message), {_quoted(Sql.CITATION)}))"
CORRECTIVE = f"corrective AS (SELECT * FROM cm WHERE regexp_matches(subject, {_quoted(Sql.FIX_WORDS)}) OR regexp_matches(lower(full_message), {_quoted(Sql.CITATION)}))"
TARGET = """target AS (SELECT DISTINCT record_id, repository, merged_at, provenance.observation_end AS obs, lower(t) AS target FROM
 (SELECT *, unnest(list_concat([merge_commit_sha, head_sha], coalesce(commit_shas, []))) AS t FROM pr) WHERE length(t) >= 6)"""
FILES = "fl AS (SELECT record_id, repository, number, merged_at, provenance.observation_end AS obs, f.path AS path, f.additions AS additions, f.deletions AS deletions FROM (SELECT *, unnest(changed_files) AS f FROM pr) WHERE f.path IS NOT NULL)"

def _hits(name: str, pattern: str, groups: list[int], source: str = "citing") -> str:
    lists = ", ".join(f"regexp_extract_all(full_message, {_quoted(pattern)}, {g}) AS g{g}" for g in [0, *groups])
    picks = ", ".join(f"g{g}[i] AS h{g}" for g in [0, *groups])
    return f"{name} AS (SELECT repository, sha, author_date, i - 1 AS pos, {picks} FROM (SELECT *, unnest(generate_series(1, len(g0))) AS i FROM (SELECT *, {lists} FROM {source})))"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


WINDOW = "author_date > merged_at AND (obs IS NULL OR author_date <= obs)"
BEGINS = "(starts_with(target, ref) OR starts_with(ref, target))"


def _prs(s: SparkSession, d: str) -> DataFrame:
    return records.requests(table(s, d, "pr_record"))


def _records(s: SparkSession, d: str) -> DataFrame:
    return records.records(table(s, d, "pr_record"))


def _commits(s: SparkSession, d: str) -> DataFrame:
    return records.commits(table(s, d, "commits"))


# ----------------------------------------------------------- references in messages


def _refs_query(name: str, pattern: str, sql: str) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        hit = correlate.mentions(_commits(s, d), refs.found(F.col("full_message"), pattern))
        return hit.select("repository", "sha", F.col("pos").cast("bigint").alias("pos"), F.col("hit.value").alias("ref"), F.col("hit.snippet").alias("snippet"))

    query.__name__ = name
    register(_with(CM, CITING, _hits("h", sql, [1])) + "SELECT repository, sha, pos, h1 AS ref, h0 AS snippet FROM h")(query)


_refs_query("refs_fixes_sha", refs.FIXES_SHA, Sql.FIXES_SHA)
_refs_query("refs_fixes_pr", refs.FIXES_PR, Sql.FIXES_PR)
_refs_query("refs_revert_commit", refs.REVERT_COMMIT, Sql.REVERT_COMMIT)
_refs_query("refs_revert_subject", refs.REVERT_SUBJECT, Sql.REVERT_SUBJECT)


@register(_with(CM, CITING, _hits("h", Sql.REGRESSION, [1, 2, 3])) + "SELECT repository, sha, pos, CASE WHEN h1 <> '' THEN h1 ELSE coalesce(h3, '') END AS named_sha, coalesce(h2, '') AS named_number, h0 AS snippet FROM h")
def refs_regression(s: SparkSession, d: str) -> DataFrame:
    hit = correlate.mentions(_commits(s, d), refs.regressions(F.col("full_message")))
    return hit.select("repository", "sha", F.col("pos").cast("bigint").alias("pos"), F.col("hit.sha").alias("named_sha"), F.col("hit.number").alias("named_number"), F.col("hit.snippet").alias("snippet"))


def _all(pattern: str, group: int) -> str:
    return f"regexp_extract_all(full_message, {_quoted(pattern)}, {group})"


@register(
    _with(CM)
    + f"""SELECT repository, sha,
 (SELECT count(DISTINCT lower(x)) FROM (SELECT unnest(list_concat({_all(Sql.FIXES_SHA, 1)}, {_all(Sql.REVERT_COMMIT, 1)}, {_all(Sql.REGRESSION, 1)}, {_all(Sql.REGRESSION, 3)})) AS x) WHERE x <> '') AS shas,
 (SELECT count(DISTINCT try_cast(x AS BIGINT)) FROM (SELECT unnest(list_concat({_all(Sql.FIXES_PR, 1)}, {_all(Sql.REGRESSION, 2)})) AS x) WHERE try_cast(x AS BIGINT) > 0) AS numbers,
 {" OR ".join(f"regexp_matches(full_message, {_quoted(p)})" for p in (Sql.FIXES_SHA, Sql.FIXES_PR, Sql.REVERT_COMMIT, Sql.REVERT_SUBJECT, Sql.REGRESSION))} AS matched FROM cm"""
)
def refs_untargeted(s: SparkSession, d: str) -> DataFrame:
    shas, numbers, matched = refs.untargeted(F.col("full_message"))
    return _commits(s, d).select("repository", "sha", F.size(shas).cast("bigint").alias("shas"), F.size(numbers).cast("bigint").alias("numbers"), matched.alias("matched"))


@register(_with(CM) + f"SELECT repository, sha, regexp_matches(subject, {_quoted(Sql.FIX_WORDS)}) AS fix_words, regexp_matches(lower(full_message), {_quoted(Sql.CITATION)}) AS citation FROM cm")
def commit_vocabulary(s: SparkSession, d: str) -> DataFrame:
    return _commits(s, d).select("repository", "sha", refs.has_fix_words(F.col("subject")).alias("fix_words"), refs.has_citation(F.col("full_message")).alias("citation"))


@register(_with(CM) + f"SELECT repository, count(*) AS merges, count(DISTINCT n) AS numbers FROM (SELECT repository, regexp_extract(subject, {_quoted(Sql.MERGE_SUBJECT)}, 1) AS n FROM cm) GROUP BY repository")
def merge_subject_numbers(s: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("subject", refs.MERGE_SUBJECT, 1).alias("n")
    return _commits(s, d).select("repository", n).groupBy("repository").agg(F.count("*").alias("merges"), F.count_distinct("n").alias("numbers"))


# ----------------------------------------------------------- strong, medium, weak signals

S_FIX = f"s1 AS (SELECT record_id, sha, 'FIXES_SHA' AS signal_type, arg_min(snippet, pos) AS snippet FROM (SELECT h.*, lower(h1) AS ref, h0 AS snippet FROM h1q h) x JOIN target USING (repository) WHERE {BEGINS} AND {WINDOW} GROUP BY record_id, sha)"
S_NUM = f"s2 AS (SELECT record_id, sha, 'FIXES_PR' AS signal_type, arg_min(h0, pos) AS snippet FROM h2q h JOIN (SELECT *, provenance.observation_end AS obs FROM pr) p ON h.repository = p.repository AND try_cast(h.h1 AS BIGINT) = p.number WHERE p.number > 0 AND {WINDOW} GROUP BY record_id, sha)"
S_REV = f"""s3a AS (SELECT record_id, sha, 0 AS turn, arg_min(h0, pos) AS snippet FROM (SELECT *, lower(h1) AS ref FROM h3q) x JOIN target USING (repository) WHERE {BEGINS} AND {WINDOW} GROUP BY record_id, sha),
s3b AS (SELECT record_id, sha, 1 AS turn, arg_min(h0, pos) AS snippet FROM h4q h JOIN (SELECT *, provenance.observation_end AS obs FROM pr) p ON h.repository = p.repository WHERE p.number > 0 AND contains(h.h1, '#' || p.number) AND {WINDOW} GROUP BY record_id, sha),
s3 AS (SELECT record_id, sha, 'EXPLICIT_REVERT' AS signal_type, arg_min(snippet, turn) AS snippet FROM (SELECT * FROM s3a UNION ALL SELECT * FROM s3b) GROUP BY record_id, sha)"""
S_REG = f"""s4x AS (SELECT record_id, sha, pos, h0 FROM (SELECT *, lower(CASE WHEN h1 <> '' THEN h1 ELSE h3 END) AS ref FROM h5q) x JOIN target USING (repository) WHERE length(ref) >= 6 AND {BEGINS} AND {WINDOW}
 UNION ALL SELECT record_id, sha, pos, h0 FROM h5q h JOIN (SELECT *, provenance.observation_end AS obs FROM pr) p ON h.repository = p.repository AND try_cast(h.h2 AS BIGINT) = p.number WHERE p.number > 0 AND {WINDOW}),
s4 AS (SELECT record_id, sha, 'REGRESSION_MENTION' AS signal_type, arg_min(h0, pos) AS snippet FROM s4x GROUP BY record_id, sha)"""
STRONG = [PR, CM, CITING, TARGET, _hits("h1q", Sql.FIXES_SHA, [1]), _hits("h2q", Sql.FIXES_PR, [1]), _hits("h3q", Sql.REVERT_COMMIT, [1]), _hits("h4q", Sql.REVERT_SUBJECT, [1]), _hits("h5q", Sql.REGRESSION, [1, 2, 3]), S_FIX, S_NUM, S_REV, S_REG]


def _strong_query(name: str, step: str, kind: str) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        return correlate.strong(table(s, d, "commits"), _prs(s, d), [kind])

    query.__name__ = name
    register(_with(*STRONG) + f"SELECT record_id, sha, signal_type, snippet FROM {step}")(query)


_strong_query("strong_fixes_sha", "s1", "FIXES_SHA")
_strong_query("strong_fixes_pr", "s2", "FIXES_PR")
_strong_query("strong_revert", "s3", "EXPLICIT_REVERT")
_strong_query("strong_regression", "s4", "REGRESSION_MENTION")

CPATH = """cp AS (SELECT DISTINCT repository, sha, path FROM (
  SELECT repository, s.source_ref AS sha, unnest(s.changed_paths) AS path FROM (SELECT repository, unnest(retrospective.strong_signals) AS s FROM pr) WHERE s IS NOT NULL
  UNION ALL SELECT repository, s.source_ref AS sha, unnest(s.changed_paths) AS path FROM (SELECT repository, unnest(retrospective.medium_signals) AS s FROM pr) WHERE s IS NOT NULL) WHERE path IS NOT NULL AND sha IS NOT NULL AND repository IS NOT NULL)"""
MEDIUM = f"""sym AS (SELECT DISTINCT repository, sha, l.path AS path, l.function AS function FROM (SELECT repository, unnest(commit_shas) AS sha, locations FROM pr) x, unnest(x.locations) AS u(l) WHERE sha IS NOT NULL),
own AS (SELECT record_id, repository, merged_at, provenance.observation_end AS obs, l.path AS path, l.function AS function FROM (SELECT *, unnest(locations) AS l FROM pr) WHERE l.path <> '' AND l.function <> ''),
md AS (SELECT DISTINCT record_id, c.sha, own.path || ':' || own.function AS function_or_path FROM own JOIN sym USING (repository, path, function) JOIN corrective c ON c.repository = own.repository AND c.sha = sym.sha WHERE NOT c.merge AND {WINDOW})"""
WEAK = f"""wk AS (SELECT record_id, c.sha, min(fl.path) AS path FROM fl JOIN cp ON cp.repository = fl.repository AND cp.path = fl.path JOIN corrective c ON c.repository = cp.repository AND c.sha = cp.sha
  WHERE NOT c.merge AND {WINDOW} AND epoch_us(author_date) - epoch_us(merged_at) <= 90 * 86400000000 GROUP BY record_id, c.sha)"""
LEGACY = f"""lg AS (SELECT DISTINCT record_id, sha, function FROM (SELECT record_id, repository, merged_at, provenance.observation_end AS obs, coalesce(len(list_filter(locations, lambda x: x IS NOT NULL)), 0) = 0 AS bare,
   unnest(list_distinct(changed_functions)) AS function FROM pr) o
 JOIN (SELECT *, merge OR (repository, sha) NOT IN (SELECT (repository, sha) FROM cp) AS blind FROM corrective) c ON c.repository = o.repository AND contains(full_message, function)
 WHERE length(function) >= 6 AND (bare OR blind) AND {WINDOW})"""


def _readable(s: SparkSession, d: str) -> DataFrame:
    return records.commit_paths(table(s, d, "pr_record"))


@register(_with(PR, CM, CORRECTIVE, MEDIUM) + "SELECT record_id, sha, function_or_path FROM md")
def medium_same_function(s: SparkSession, d: str) -> DataFrame:
    """Corrective commits to a request's own functions; functions of a commit are those of the request it belongs to.

    The tables hold no diffs; where there are some, :func:`diffs.diff_symbols` gives the functions.
    """
    prs = _prs(s, d)
    return correlate.same_function(table(s, d, "commits"), records.locations_of_commits(prs), prs)


MADE = f"""own2 AS (SELECT DISTINCT record_id, repository, merged_at, obs, path, regexp_extract(path, '[^/]+$') AS function FROM fl), sym2 AS (SELECT repository, sha, path, regexp_extract(path, '[^/]+$') AS function FROM cp),
mf AS (SELECT DISTINCT record_id, c.sha, own2.path || ':' || own2.function AS function_or_path FROM own2 JOIN sym2 USING (repository, path, function) JOIN corrective c ON c.repository = own2.repository AND c.sha = sym2.sha WHERE function <> '' AND NOT c.merge AND {WINDOW})"""


@register(_with(PR, CM, CORRECTIVE, FILES, CPATH, MADE) + "SELECT record_id, sha, function_or_path FROM mf")
def same_made_function(s: SparkSession, d: str) -> DataFrame:
    """The same join over made functions: a file's own name stands for the function in it, as no commit's functions are known that meet a request's."""
    name = lambda p: F.regexp_extract(p, "[^/]+$", 0)
    made = F.transform(F.filter("changed_files", lambda f: f["path"].isNotNull()), lambda f: F.struct(f["path"].alias("path"), name(f["path"]).alias("function")))
    prs = _prs(s, d).withColumn("changed_function_locations", made)
    return correlate.same_function(table(s, d, "commits"), _readable(s, d).withColumn("function", name(F.col("path"))), prs)


@register(_with(PR, CM, CORRECTIVE, FILES, CPATH, WEAK) + "SELECT record_id, sha, path FROM wk")
def weak_same_file(s: SparkSession, d: str) -> DataFrame:
    return correlate.same_file(table(s, d, "commits"), _readable(s, d), _prs(s, d))


@register(_with(PR, CM, CORRECTIVE, CPATH, LEGACY) + "SELECT record_id, sha, function FROM lg")
def weak_legacy_name(s: SparkSession, d: str) -> DataFrame:
    return correlate.legacy_names(table(s, d, "commits"), _prs(s, d), _readable(s, d))


@register(_with(PR, CM) + "SELECT DISTINCT record_id, sha, function FROM (SELECT record_id, repository, unnest(changed_functions) AS function FROM pr) o JOIN cm USING (repository) WHERE length(function) >= 6 AND contains(full_message, function)")
def function_mentions(s: SparkSession, d: str) -> DataFrame:
    """Commits whose message contains a function of a request, before or after its merge."""
    names = _prs(s, d).select("record_id", "repository", F.explode("changed_functions").alias("function"))
    return correlate.naming(table(s, d, "commits"), names).select("record_id", "sha", "function")


PATCH = """pt AS (SELECT record_id, sha, min(patch) AS patch FROM (SELECT record_id, s.source_ref AS sha, s.logical_patch_id AS patch FROM (SELECT record_id, unnest(retrospective.strong_signals) AS s FROM pr)
  UNION ALL SELECT record_id, s.source_ref, s.logical_patch_id FROM (SELECT record_id, unnest(retrospective.medium_signals) AS s FROM pr)) WHERE sha IS NOT NULL AND patch <> '' GROUP BY ALL)"""
RANK = """rk AS (SELECT record_id, coalesce(a.n, 0) AS strong_leads, coalesce(b.n, 0) AS medium_leads, coalesce(w.n, 0) AS weak_signals FROM pr
 LEFT JOIN (SELECT record_id, count(DISTINCT coalesce(patch, 'sha:' || sha)) AS n FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4) LEFT JOIN pt USING (record_id, sha) GROUP BY 1) a USING (record_id)
 LEFT JOIN (SELECT record_id, count(DISTINCT coalesce(patch, 'sha:' || sha)) AS n FROM md LEFT JOIN pt USING (record_id, sha) GROUP BY 1) b USING (record_id)
 LEFT JOIN (SELECT record_id, count(*) AS n FROM (SELECT record_id FROM wk UNION ALL SELECT record_id FROM lg) GROUP BY 1) w USING (record_id)),
 ranked AS (SELECT *, least(1.0::DOUBLE, CASE WHEN strong_leads > 0 THEN 1.0::DOUBLE WHEN medium_leads > 0 THEN 0.5::DOUBLE + 0.05::DOUBLE * medium_leads WHEN weak_signals > 0 THEN 0.1::DOUBLE + 0.02::DOUBLE * weak_signals ELSE 0.0::DOUBLE END) AS rank_score FROM rk)"""
EVERYTHING = [*STRONG, CORRECTIVE, FILES, CPATH, MEDIUM, WEAK, LEGACY, PATCH, RANK]


@register(_with(*EVERYTHING) + "SELECT record_id, strong_leads, medium_leads, weak_signals, rank_score FROM ranked")
def rank_score(s: SparkSession, d: str) -> DataFrame:
    """Every request's strength of later evidence, recomputed from the commit log."""
    log, pr_record, prs = table(s, d, "commits"), table(s, d, "pr_record"), _prs(s, d)
    known = records.commit_paths(pr_record)
    medium = correlate.same_function(log, records.locations_of_commits(prs), prs)
    weak = correlate.same_file(log, known, prs).select("record_id").unionByName(correlate.legacy_names(log, prs, known).select("record_id"))
    return correlate.rank(prs, correlate.strong(log, prs), medium, weak, records.patches(pr_record))


# ----------------------------------------------------------- rules


def _rule_sql(r: rules.RuleSet) -> str:
    hits = []
    for p in r.paths:
        m = f"list_filter(list_transform(coalesce(changed_files, []), lambda f: f.path), lambda p: regexp_matches(p, {_quoted(p.pattern)}))[1]"
        hits.append((f"{m} IS NOT NULL", "'path'", p))
    for k in r.keywords:
        fields = {"pr_title": ("title", "[title]"), "pr_body": ("body", "[body]"), "diff_symbols": ("symbol", "coalesce(changed_functions, [])"), "commit_messages": ("commit_msg", "coalesce(commit_messages, [])")}
        tests = [(fields[f][0], f"list_filter({fields[f][1]}, lambda t: regexp_matches(t, {_quoted(k.pattern)}))[1] IS NOT NULL") for f in k.fields]
        hits.append((" OR ".join(t for _, t in tests), "CASE " + " ".join(f"WHEN {t} THEN '{n}'" for n, t in tests) + " END", k))
    points = " + ".join(f"CASE WHEN {c} THEN {h.weight}::DOUBLE ELSE 0::DOUBLE END" for c, _, h in hits)
    texts = ", ".join(f"CASE WHEN {c} THEN {loc} || ':{h.name} (+{h.weight:.2f})' END" for c, loc, h in hits)
    return f"SELECT record_id, 0::DOUBLE + {points} AS raw_points, list_filter([{texts}], lambda x: x IS NOT NULL) AS parts FROM pr"


SCORED = _with(PR, f"sc AS ({_rule_sql(rules.SAMPLE)})", "sd AS (SELECT *, least(1.0::DOUBLE, raw_points) AS score FROM sc)")


@register(SCORED + f"SELECT record_id, raw_points, score, CASE WHEN score >= {rules.HIGH} THEN 'HIGH' WHEN score >= {rules.MEDIUM} THEN 'MEDIUM' ELSE 'LOW' END AS category FROM sd")
def heuristic_score(s: SparkSession, d: str) -> DataFrame:
    return rules.evaluate(_prs(s, d), rules.SAMPLE).select("record_id", "raw_points", "score", "category")


@register(SCORED + f"SELECT record_id, CASE WHEN len(parts) = 0 THEN '{rules.NO_MATCH}' ELSE array_to_string(parts, ', ') END AS explanation FROM sd")
def heuristic_explain(s: SparkSession, d: str) -> DataFrame:
    return rules.evaluate(_prs(s, d), rules.SAMPLE).select("record_id", "explanation")


# ----------------------------------------------------------- projections and aggregates

TIER = "CASE WHEN len(retrospective.strong_signals) > 0 THEN 'strong' WHEN len(retrospective.medium_signals) > 0 THEN 'medium' WHEN len(retrospective.weak_signals) > 0 THEN 'weak' ELSE 'none' END"


@register(_with(PR) + f"SELECT {TIER} AS tier, stateful.category AS category, count(*) AS n, avg(stateful.score) AS mean_score FROM pr GROUP BY ALL")
def stats_summary(s: SparkSession, d: str) -> DataFrame:
    return _records(s, d).groupBy(records.tier().alias("tier"), F.col("stateful.category").alias("category")).agg(F.count("*").alias("n"), F.avg("stateful.score").alias("mean_score"))


@register(
    _with(PR)
    + """SELECT record_id, repository, number, retrospective.summary_rank_score AS rank, stateful.score AS score FROM pr
 WHERE stateful.score >= 0.3 AND (len(retrospective.strong_signals) > 0 OR len(retrospective.medium_signals) > 0)"""
)
def export_ranked(s: SparkSession, d: str) -> DataFrame:
    """Requests with score and evidence, strongest first; the order is the sink's, not the comparison's."""
    has = (records.count(F.col("retrospective.strong_signals")) > 0) | (records.count(F.col("retrospective.medium_signals")) > 0)
    out = _records(s, d).where("stateful.score >= 0.3").where(has)
    out = out.select("record_id", "original.repository", "original.number", F.col("retrospective.summary_rank_score").alias("rank"), F.col("stateful.score").alias("score"))
    return out.orderBy(F.desc("rank"), F.desc("score"), "number")


@register(_with(PR) + "SELECT record_id, title, number FROM pr WHERE number = 250")
def point_lookup(s: SparkSession, d: str) -> DataFrame:
    """One request by number; the predicate reaches the Parquet scan."""
    return table(s, d, "pr_record").where(F.col("original.number") == 250).dropDuplicates(["record_id"]).select("record_id", "original.title", "original.number")


SCOPE_OF = """CASE WHEN regexp_matches(lower(p), '^(?:tests|topotests)/|/topotests/') THEN 'test' WHEN regexp_matches(lower(p), '^(?:doc|docs|man)/|\\.(?:rst|md)$') THEN 'docs'
 WHEN regexp_matches(lower(p), '^(?:debian|redhat|docker|pkg)/|\\.spec$') THEN 'packaging' ELSE 'code' END"""


@register(
    _with(PR, "sg AS (SELECT record_id, unnest(retrospective.strong_signals) AS s, generate_subscripts(retrospective.strong_signals, 1) AS pos FROM pr)")
    + f"""SELECT record_id, pos, CASE WHEN len(k) = 0 THEN 'unknown' WHEN len(k) > 1 THEN 'mixed' ELSE k[1] END AS scope FROM
 (SELECT record_id, pos, list_distinct(list_transform(list_filter(coalesce(s.changed_paths, []), lambda p: p IS NOT NULL), lambda p: {SCOPE_OF})) AS k FROM sg WHERE s IS NOT NULL)"""
)
def evidence_scope(s: SparkSession, d: str) -> DataFrame:
    sg = _records(s, d).select("record_id", F.posexplode("retrospective.strong_signals").alias("at", "s")).where("s is not null")
    return sg.select("record_id", (F.col("at") + 1).cast("bigint").alias("pos"), paths.evidence_scope(F.col("s.changed_paths")).alias("scope"))


SUBSYSTEM = """CASE WHEN parts[1] = '' THEN '(root)' WHEN len(parts) > 2 AND lower(parts[1]) IN ('internal', 'src', 'pkg', 'cmd', 'lib64', 'source') THEN parts[1] || '/' || parts[2] ELSE parts[1] END"""
PRIMARY = f"""wt AS (SELECT record_id, name, sum(coalesce(additions, 0) + coalesce(deletions, 0)) AS lines FROM (SELECT *, {SUBSYSTEM} AS name FROM (SELECT *, string_split(path, '/') AS parts FROM fl)) GROUP BY ALL),
ps AS (SELECT DISTINCT ON (record_id) record_id, name FROM (SELECT *, lower(name) IN ('tests','test','doc','docs','tools','.github','ci','.ci','m4') OR (NOT contains(name, '/') AND (contains(name, '.') OR lower(name) = 'makefile')) AS anc FROM wt) ORDER BY record_id, anc, lines DESC, name),
sub AS (SELECT record_id, coalesce(ps.name, '(none)') AS subsystem FROM pr LEFT JOIN ps USING (record_id))"""


@register(_with(PR, FILES, PRIMARY) + "SELECT record_id, subsystem FROM sub")
def primary_subsystem(s: SparkSession, d: str) -> DataFrame:
    return records.primary_subsystem(_prs(s, d))


BAND = "CASE WHEN lines <= 0 THEN '0' WHEN lines <= 10 THEN '1-10' WHEN lines <= 50 THEN '11-50' WHEN lines <= 200 THEN '51-200' WHEN lines <= 1000 THEN '201-1000' ELSE '1001+' END"
LINES = "ln AS (SELECT record_id, coalesce(list_sum(list_transform(list_filter(changed_files, lambda f: f IS NOT NULL), lambda f: coalesce(f.additions, 0) + coalesce(f.deletions, 0))), 0)::BIGINT AS lines FROM pr)"


@register(_with(PR, LINES) + f"SELECT record_id, lines AS changed_lines, {BAND} AS size_band FROM ln")
def size_and_lines(s: SparkSession, d: str) -> DataFrame:
    return records.sizes(_prs(s, d)).withColumn("size_band", paths.size_band(F.col("changed_lines")))


@register(_with(PR) + "SELECT record_id, CASE WHEN provenance.observation_end >= merged_at THEN (epoch_us(provenance.observation_end) - epoch_us(merged_at)) // 86400000000 END AS days FROM pr")
def exposure_days(s: SparkSession, d: str) -> DataFrame:
    return _prs(s, d).select("record_id", records.exposure(F.col("merged_at"), F.col("observation_end")).alias("days"))


@register(
    _with(PR)
    + """SELECT record_id, coalesce(len(retrospective.strong_signals), 0) = 0 AND coalesce(len(retrospective.medium_signals), 0) = 0 AND coalesce(len(retrospective.weak_signals), 0) = 0
 AND coalesce(len(retrospective.commit_relationships), 0) = 0 AND coalesce(retrospective.summary_rank_score, 0) = 0 AS zero FROM pr"""
)
def zero_signal(s: SparkSession, d: str) -> DataFrame:
    none = F.lit(True)
    for t in ("strong_signals", "medium_signals", "weak_signals", "commit_relationships"):
        none = none & (records.count(F.col(f"retrospective.{t}")) == 0)
    return _records(s, d).select("record_id", (none & (F.coalesce("retrospective.summary_rank_score", F.lit(0.0)) == 0)).alias("zero"))


@register(
    _with(PR)
    + """SELECT record_id, coalesce(list_min(list_transform(retrospective.strong_signals, lambda x: x."timestamp")), list_min(list_transform(retrospective.medium_signals, lambda x: x."timestamp"))) AS fixed_at FROM pr"""
)
def earliest_fix(s: SparkSession, d: str) -> DataFrame:
    least = lambda t: F.array_min(F.transform(f"retrospective.{t}", lambda x: x["timestamp"]))
    return _records(s, d).select("record_id", F.coalesce(least("strong_signals"), least("medium_signals")).alias("fixed_at"))


@register(_with(PR, FILES, PRIMARY) + "SELECT record_id, repository, subsystem, k FROM (SELECT record_id, repository, subsystem, row_number() OVER (PARTITION BY repository, subsystem ORDER BY record_id) AS k FROM pr JOIN sub USING (record_id)) WHERE k <= 3")
def subsystem_quota(s: SparkSession, d: str) -> DataFrame:
    """The first three requests of each subsystem in input order; bounded heaps before the shuffle."""
    prs = _prs(s, d)
    rows = prs.select("record_id", "repository").join(records.primary_subsystem(prs), "record_id")
    w = Window.partitionBy("repository", "subsystem").orderBy("record_id")
    return rows.withColumn("k", F.row_number().over(w).cast("bigint")).where("k <= 3").select("record_id", "repository", "subsystem", "k")


@register(
    _with(PR)
    + """SELECT record_id, count(*) AS signals, count(DISTINCT r) AS refs, count(DISTINCT p) AS patches FROM (SELECT record_id, s.source_ref AS r, s.logical_patch_id AS p FROM (SELECT record_id, unnest(retrospective.strong_signals) AS s FROM pr) WHERE s IS NOT NULL
 UNION ALL SELECT record_id, s.source_ref, s.logical_patch_id FROM (SELECT record_id, unnest(retrospective.medium_signals) AS s FROM pr) WHERE s IS NOT NULL) GROUP BY record_id"""
)
def signal_counts(s: SparkSession, d: str) -> DataFrame:
    return _signals(s, d).groupBy("record_id").agg(F.count("*").alias("signals"), F.count_distinct("source_ref").alias("refs"), F.count_distinct("logical_patch_id").alias("patches"))


def _signals(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d)
    cols = ["record_id", "x.source_ref", "x.logical_patch_id"]
    parts = [r.select("record_id", F.explode(f"retrospective.{t}").alias("x")).where("x is not null").select(*cols) for t in ("strong_signals", "medium_signals")]
    return parts[0].unionByName(parts[1])


@register(
    _with(PR)
    + """SELECT p AS patch, count(*) AS signals, array_to_string(list_sort(list_distinct(list(r))), ',') AS refs FROM (SELECT s.source_ref AS r, s.logical_patch_id AS p FROM (SELECT unnest(retrospective.strong_signals) AS s FROM pr) WHERE s IS NOT NULL
 UNION ALL SELECT s.source_ref, s.logical_patch_id FROM (SELECT unnest(retrospective.medium_signals) AS s FROM pr) WHERE s IS NOT NULL) WHERE p IS NOT NULL AND p <> '' GROUP BY p"""
)
def logical_patch_groups(s: SparkSession, d: str) -> DataFrame:
    rows = _signals(s, d).where("logical_patch_id != ''").groupBy(F.col("logical_patch_id").alias("patch"), "source_ref").agg(F.count("*").alias("n"))
    return rows.groupBy("patch").agg(F.sum("n").alias("signals"), F.array_join(F.array_sort(F.collect_set("source_ref")), ",").alias("refs"))


@register(
    _with(PR)
    + """SELECT record_id, r.source_ref AS sha, r.lineage.later_removed_line_count AS removed, CASE WHEN r.lineage.analyzed_removed_line_count <> 0 THEN r.lineage.lines_blamed_to_original_pr::DOUBLE / r.lineage.analyzed_removed_line_count END AS fraction
 FROM (SELECT record_id, unnest(retrospective.commit_relationships) AS r FROM pr) WHERE r.lineage IS NOT NULL"""
)
def lineage_fraction(s: SparkSession, d: str) -> DataFrame:
    rows = _records(s, d).select("record_id", F.explode("retrospective.commit_relationships").alias("r")).where("r.lineage is not null")
    share = F.try_divide(F.col("r.lineage.lines_blamed_to_original_pr").cast("double"), F.col("r.lineage.analyzed_removed_line_count").cast("double"))
    return rows.select("record_id", F.col("r.source_ref").alias("sha"), F.col("r.lineage.later_removed_line_count").alias("removed"), share.alias("fraction"))


@register(
    _with(PR)
    + """SELECT repository, record_id, coalesce(sum(o.later_removed_matching_original_additions + o.later_added_matching_original_removals), 0) AS overlap, count(*) AS paths FROM
 (SELECT repository, record_id, unnest(r.reversal.path_overlaps) AS o FROM (SELECT repository, record_id, unnest(retrospective.commit_relationships) AS r FROM pr) WHERE r.reversal IS NOT NULL) WHERE o IS NOT NULL GROUP BY ALL"""
)
def reversal_totals(s: SparkSession, d: str) -> DataFrame:
    r = _records(s, d).select("original.repository", "record_id", F.explode("retrospective.commit_relationships").alias("r")).where("r.reversal is not null")
    o = r.select("repository", "record_id", F.explode("r.reversal.path_overlaps").alias("o")).where("o is not null")
    both = F.col("o.later_removed_matching_original_additions") + F.col("o.later_added_matching_original_removals")
    return o.groupBy("repository", "record_id").agg(F.coalesce(F.sum(both), F.lit(0)).alias("overlap"), F.count("*").alias("paths"))


# ----------------------------------------------------------- identity, digests, provenance


@register(
    """SELECT DISTINCT case_id, 'case-' || substr(sha256(repository || '#' || pr || '@' || strftime(t AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(t) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((epoch_us(t) % 1000000)::VARCHAR, 6, '0'), '0') END || 'Z'), 1, 16) AS computed FROM (SELECT case_id, repository, pr,
 try_cast(regexp_replace(regexp_replace(replace(cutoff_timestamp, ' ', 'T'), '(\\.\\d{6})\\d+', '\\1'), '([+-]\\d{2})(\\d{2})$', '\\1:\\2') AS TIMESTAMPTZ) AS t FROM review_metadata) WHERE t IS NOT NULL"""
)
def case_id(s: SparkSession, d: str) -> DataFrame:
    t = parse_time(F.col("cutoff_timestamp"))
    text = F.concat("repository", F.lit("#"), F.col("pr").cast("string"), F.lit("@"), exact_time(t))
    return table(s, d, "review_metadata").where(t.isNotNull()).select("case_id", F.concat(F.lit("case-"), F.substring(F.sha2(text, 256), 1, 16)).alias("computed")).distinct()


@register(
    _with(PR, "hs AS (SELECT repository, sha256(record_id || '|' || coalesce(title, '')) AS h FROM pr)", "bk AS (SELECT repository, substr(h, 1, 2) AS b, sha256(array_to_string(list_sort(list(h)), chr(10)) || chr(10)) AS inner_, count(*) AS n FROM hs GROUP BY ALL)")
    + "SELECT repository, sha256(array_to_string(list_sort(list(b || ':' || inner_)), chr(10)) || chr(10)) AS digest, sum(n)::BIGINT AS n FROM bk GROUP BY repository"
)
def source_digest(s: SparkSession, d: str) -> DataFrame:
    """An order-free digest of each source's records, in two levels."""
    h = F.sha2(F.concat(F.col("record_id").cast("string"), F.lit("|"), F.coalesce("title", F.lit(""))), 256)
    return records.two_level_digest(_prs(s, d).select("repository", h.alias("h")), ["repository"], "h")


@register(_with(PR) + "SELECT repository, coalesce(min(to_json(provenance)::VARCHAR) = max(to_json(provenance)::VARCHAR), true) AS provenance_uniform FROM pr GROUP BY repository")
def provenance_uniform(s: SparkSession, d: str) -> DataFrame:
    """Whether all records of a source carry the same provenance, whatever fields it has."""
    rows = _records(s, d).select("original.repository", F.to_json("provenance").alias("provenance"))
    return merging.uniform(rows, ["repository"], ["provenance"])


@register("SELECT record_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(schema_version))), ',') AS labels FROM pr_record GROUP BY record_id HAVING count(*) > 1")
def source_duplicates(s: SparkSession, d: str) -> DataFrame:
    return merging.duplicates(table(s, d, "pr_record"), ["record_id"], "schema_version")


@register(_with(PR) + "SELECT repository, record_id, (row_number() OVER (PARTITION BY repository ORDER BY number NULLS FIRST, record_id) - 1) // 50 AS batch FROM pr")
def batch_numbers(s: SparkSession, d: str) -> DataFrame:
    return merging.batches(_prs(s, d).select("repository", "record_id", "number"), ["repository"], "number", tie="record_id").select("repository", "record_id", "batch")


RECLASSED = _with(*EVERYTHING, f"cls AS (SELECT {TIER} AS a, CASE WHEN strong_leads > 0 THEN 'strong' WHEN medium_leads > 0 THEN 'medium' WHEN weak_signals > 0 THEN 'weak' ELSE 'none' END AS b FROM pr JOIN ranked USING (record_id))")


@register(RECLASSED + "SELECT a AS from_class, b AS to_class, count(*) AS n FROM cls GROUP BY ALL")
def flip_transitions(s: SparkSession, d: str) -> DataFrame:
    """Stored evidence classes against those recomputed from the commit log."""
    old = records.tiers(table(s, d, "pr_record"))
    new = rank_score(s, d).select("record_id", F.when(F.col("strong_leads") > 0, "strong").when(F.col("medium_leads") > 0, "medium").when(F.col("weak_signals") > 0, "weak").otherwise("none").alias("class"))
    return merging.transitions(old, new, ["record_id"], "class")


@register(RECLASSED + "SELECT count(*) AS compared, count_if(a = b) AS unchanged, count_if(a <> b) AS flipped, count_if(a <> b AND a = 'none') AS from_none FROM cls")
def merge_flips(s: SparkSession, d: str) -> DataFrame:
    return merging.flip_report(flip_transitions(s, d))


@register(_with(PR) + "SELECT record_id, CASE WHEN record_id % 3 = 0 THEN 'subset' ELSE 'base' END AS side FROM pr")
def replace_by_key(s: SparkSession, d: str) -> DataFrame:
    """Re-delivered records, here a third of them, in place of their predecessors."""
    base = _records(s, d).select("record_id")
    subset = base.where("record_id % 3 = 0").withColumn("side", F.lit("subset"))
    return merging.replace_by_key(base.withColumn("side", F.lit("base")), subset, ["record_id"])


# ----------------------------------------------------------- ranks, baselines, islands


@register(_with(PR) + "SELECT DISTINCT repository, stateful.score AS score, (rank() OVER w - 1) AS below, ((rank() OVER w - 1) / count(*) OVER (PARTITION BY repository)::DOUBLE + cume_dist() OVER w) / 2 AS percentile FROM pr WHERE stateful.score IS NOT NULL WINDOW w AS (PARTITION BY repository ORDER BY stateful.score)")
def percentile_midrank(s: SparkSession, d: str) -> DataFrame:
    rows = _records(s, d).select("original.repository", F.col("stateful.score").alias("score"))
    out = ranking.below_and_equal(rows, ["repository"], "score", F.floor(F.col("score") * 100))
    return out.select("repository", "score", "below", ranking.midrank_percentile().alias("percentile"))


@register(
    _with(PR, FILES, PRIMARY, "v AS (SELECT repository, sub.subsystem, avg(stateful.score) AS score FROM pr JOIN sub USING (record_id) WHERE stateful.score IS NOT NULL GROUP BY ALL)")
    + "SELECT repository, subsystem, CASE WHEN p < 1/3::DOUBLE THEN 1 WHEN p < 2/3::DOUBLE THEN 2 ELSE 3 END AS tercile FROM (SELECT *, (rank() OVER (PARTITION BY repository ORDER BY score) - 1) / count(*) OVER (PARTITION BY repository)::DOUBLE AS p FROM (SELECT repository, subsystem, round(score, 9) AS score FROM v))"
)
def tercile(s: SparkSession, d: str) -> DataFrame:
    """Subsystems in thirds by mean score within a repository."""
    r = _records(s, d)
    rows = r.select("record_id", "original.repository", F.col("stateful.score").alias("score")).where("score is not null").join(records.primary_subsystem(_prs(s, d)), "record_id")
    mean = rows.groupBy("repository", "subsystem").agg(F.round(F.avg("score"), 9).alias("score"))
    rank = ranking.below_and_equal(mean, ["repository"], "score", F.floor(F.col("score") * 100))
    return mean.join(rank, ["repository", "score"]).select("repository", "subsystem", ranking.tercile().alias("tercile"))


@register(
    _with(PR, FILES, f"x AS (SELECT repository, record_id, {SUBSYSTEM} AS subsystem, additions, deletions FROM (SELECT *, string_split(path, '/') AS parts FROM fl))", "st AS (SELECT record_id, len(retrospective.strong_signals) > 0 AS fixed FROM pr)")
    + """SELECT repository, subsystem, count(DISTINCT record_id) AS changes, sum(coalesce(additions, 0) + coalesce(deletions, 0))::BIGINT AS churn, count(DISTINCT CASE WHEN fixed THEN record_id END) AS defects,
 count(DISTINCT CASE WHEN fixed THEN record_id END) / count(DISTINCT record_id)::DOUBLE AS density FROM x JOIN st USING (record_id) GROUP BY ALL"""
)
def baseline_features(s: SparkSession, d: str) -> DataFrame:
    """Changes, churn, defects and defect density of each subsystem.

    A record counts once a subsystem: its files are summed first, so no distinct count is needed.
    """
    prs = _prs(s, d)
    fixed = records.tiers(table(s, d, "pr_record")).select("record_id", (F.col("class") == "strong").alias("fixed"))
    churn = F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    once = records.files(prs).groupBy("repository", "record_id", paths.subsystem(F.col("path")).alias("subsystem")).agg(F.sum(churn).alias("churn")).join(fixed, "record_id")
    out = once.groupBy("repository", "subsystem").agg(F.count("*").alias("changes"), F.sum("churn").alias("churn"), F.count_if("fixed").alias("defects"))
    return out.withColumn("density", F.col("defects") / F.col("changes"))


@register(
    _with(PR, CM, FILES, PRIMARY, f"""cited AS (SELECT repository, sha, lower(unnest({_all(Sql.FIXES_SHA, 1)})) AS ref FROM cm)""", """byref AS (SELECT c.repository, c.sha, c.ref, min(t.record_id) AS record_id FROM cited c JOIN (SELECT record_id, repository, lower(unnest(list_concat([merge_commit_sha, head_sha], coalesce(commit_shas, [])))) AS target FROM pr) t
   ON c.repository = t.repository AND length(t.target) >= 6 AND (starts_with(t.target, c.ref) OR starts_with(c.ref, t.target)) GROUP BY ALL)""")
    + "SELECT c.repository, c.sha, c.ref, coalesce(s.subsystem, '(self)') AS subsystem FROM (SELECT DISTINCT repository, sha, ref FROM cited) c LEFT JOIN byref b ON b.repository = c.repository AND b.sha = c.sha AND b.ref = c.ref LEFT JOIN sub s ON s.record_id = b.record_id"
)
def defect_attribution(s: SparkSession, d: str) -> DataFrame:
    """Each cited fix to the subsystem of the change it fixes, else to itself."""
    prs = _prs(s, d)
    cited = _commits(s, d).select("repository", "sha", F.explode(F.regexp_extract_all("full_message", F.lit(refs.FIXES_SHA), F.lit(1))).alias("ref")).select("repository", "sha", F.lower("ref").alias("ref")).distinct()
    t = records.targets(prs).select("record_id", "repository", "target").withColumn("block", F.substring("target", 1, 6))
    hit = cited.withColumn("block", F.substring("ref", 1, 6)).join(t, ["repository", "block"]).where(F.col("target").startswith(F.col("ref")) | F.col("ref").startswith(F.col("target")))
    first = hit.groupBy("repository", "sha", "ref").agg(F.min("record_id").alias("record_id"))
    named = first.join(records.primary_subsystem(prs), "record_id").select("repository", "sha", "ref", "subsystem")
    return cited.join(named, ["repository", "sha", "ref"], "left").select("repository", "sha", "ref", F.coalesce("subsystem", F.lit("(self)")).alias("subsystem"))


@register()
def defect_origin(s: SparkSession, d: str) -> DataFrame:
    """Each corrective commit to the subsystem it fixes: by its ids, then by its numbers, else its own.

    Every commit with a strong reference counts, also where nothing could be captured. Tables hold
    no commit's files but those of requests and of stored signals; a commit whose files are
    unknown has a null subsystem.
    """
    return relations.defect_origins(_commits(s, d), _prs(s, d), records.commit_paths(table(s, d, "pr_record")))


@register(_with(PR) + "SELECT repository, min(number) AS first, max(number) AS last, count(*) AS n FROM (SELECT repository, number, number - row_number() OVER (PARTITION BY repository ORDER BY number) AS g FROM (SELECT DISTINCT repository, number FROM pr WHERE number > 0)) GROUP BY repository, g")
def number_islands(s: SparkSession, d: str) -> DataFrame:
    return ranking.islands(_prs(s, d), ["repository"], "number")


# ----------------------------------------------------------- lines and texts


@register(
    """WITH e AS (SELECT DISTINCT edit_id, repository, pr, diff FROM body_edits WHERE diff IS NOT NULL), n AS (SELECT *, lead(diff) OVER (PARTITION BY repository, pr ORDER BY edit_id) AS later FROM e),
 a AS (SELECT edit_id, x, count(*) AS n FROM (SELECT edit_id, unnest(string_split(diff, chr(10))) AS x FROM n WHERE later IS NOT NULL) GROUP BY ALL), b AS (SELECT edit_id, x, count(*) AS n FROM (SELECT edit_id, unnest(string_split(later, chr(10))) AS x FROM n WHERE later IS NOT NULL) GROUP BY ALL)
 SELECT edit_id, sum(coalesce(a.n, 0))::BIGINT AS left_items, sum(coalesce(b.n, 0))::BIGINT AS right_items, sum(least(coalesce(a.n, 0), coalesce(b.n, 0)))::BIGINT AS shared FROM a FULL JOIN b USING (edit_id, x) GROUP BY edit_id"""
)
def multiset_overlap(s: SparkSession, d: str) -> DataFrame:
    """Lines that successive versions of a description share."""
    own, later = _edit_pairs(s, d)
    lines = lambda x: x.select("edit_id", F.explode(F.split("diff", "\n")).alias("line"))
    return diffs.multiset_overlap(lines(own), lines(later), ["edit_id"], "line")


def _edit_pairs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(edit_id, diff) of every edit that has a successor, and the successors' texts under the same id."""
    edits = table(s, d, "body_edits").where("diff is not null and edit_id is not null")
    order = asof.successors(edits.select("repository", "pr", "edit_id").distinct(), ["repository", "pr"], "edit_id").select("edit_id", "later")
    texts = edits.select("edit_id", "diff").dropDuplicates(["edit_id"])
    return order.select("edit_id").join(texts, "edit_id"), order.join(texts.withColumnRenamed("edit_id", "later"), "later").select("edit_id", "diff")


TRIMMED = r"regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"


@register(
    f"""SELECT doc_id, count(*) AS lines, count_if(NOT (t IN ('{{', '}}', '}};', '()', '{{}}', '[]', '(', ')', ';', 'else', 'else {{') OR starts_with(t, '//') OR starts_with(t, '/*') OR starts_with(t, '*') OR strlen(t) < 3)) AS substantive
 FROM (SELECT doc_id, {TRIMMED} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id"""
)
def substantive_lines(s: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    n = F.size(F.filter(lines, lambda x: diffs.substantive(x).isNotNull()))
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(lines).cast("bigint").alias("lines"), n.cast("bigint").alias("substantive"))


@register(_with(PR, FILES) + "SELECT record_id, path, CASE WHEN additions > 0 AND deletions = 0 THEN 'added' WHEN additions = 0 AND deletions > 0 THEN 'deleted' ELSE 'modified' END AS status, additions, deletions FROM fl WHERE additions >= 0 AND deletions >= 0")
def numstat_parse(s: SparkSession, d: str) -> DataFrame:
    """Changed files written as numstat text and read back."""
    text = F.array_join(F.transform(F.filter("changed_files", lambda f: f.isNotNull()), lambda f: F.concat(f["additions"].cast("string"), F.lit("\t"), f["deletions"].cast("string"), F.lit("\t"), f["path"])), "\n")
    return _prs(s, d).select("record_id", F.explode(diffs.numstat(text)).alias("f")).select("record_id", "f.path", "f.status", "f.additions", "f.deletions")


@register()
def document_diff_symbols(s: SparkSession, d: str) -> DataFrame:
    """Functions named by diffs inside documents; a stateful line parser, checked on fixtures."""
    return diffs.diff_symbols(table(s, d, "documents").select(F.col("doc_id").alias("sha"), F.col("text").alias("raw_diff")))


@register(f"SELECT item_id, array_to_string(list_sort(list_distinct(list_transform(list_concat(coalesce(cve_ids, []), regexp_extract_all(coalesce(body, ''), {_quoted(Sql.CVE)})), lambda x: upper(x)))), ',') AS cves FROM eval_keys")
def keys_cve(s: SparkSession, d: str) -> DataFrame:
    text = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(refs.java(refs.CVE)), F.lit(0))
    ids = F.concat(F.coalesce("cve_ids", F.array().cast("array<string>")), text)
    return table(s, d, "eval_keys").select("item_id", F.array_join(F.array_sort(F.array_distinct(F.transform(ids, F.upper))), ",").alias("cves"))


@register(f"SELECT case_id, count(DISTINCT n) AS refs, min(n) AS least, max(n) AS most FROM (SELECT case_id, try_cast(unnest(regexp_extract_all(body, {_quoted(Sql.NUMBER_REF)}, 1)) AS BIGINT) AS n FROM discussion WHERE case_id IS NOT NULL) WHERE n > 0 GROUP BY case_id")
def keys_refs(s: SparkSession, d: str) -> DataFrame:
    """Numbers that a case's discussion refers to; pairs are made distinct before they are counted."""
    n = F.explode(F.regexp_extract_all("body", F.lit(refs.java(refs.NUMBER_REF)), F.lit(1))).alias("n")
    rows = table(s, d, "discussion").where("case_id is not null").select("case_id", n).select("case_id", F.col("n").try_cast("bigint").alias("n")).where("n > 0").distinct()
    return rows.groupBy("case_id").agg(F.count("*").alias("refs"), F.min("n").alias("least"), F.max("n").alias("most"))


@register(
    """WITH k AS (SELECT DISTINCT item_id, lower(s) AS sha FROM (SELECT item_id, unnest(fixing_shas) AS s FROM eval_keys) WHERE s IS NOT NULL), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\b[0-9a-f]{40}\\b')) AS sha FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, item_id FROM d JOIN k USING (sha) GROUP BY ALL"""
)
def forbidden_values(s: SparkSession, d: str) -> DataFrame:
    """Documents that hold a forbidden commit id: texts give their ids, which join by equality."""
    keys = table(s, d, "eval_keys").select("item_id", F.explode("fixing_shas").alias("sha")).where("sha is not null").select("item_id", F.lower("sha").alias("sha"))
    ids = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(refs.java(r"\b[0-9a-f]{40}\b")), F.lit(0))).alias("sha")
    return table(s, d, "documents").select("doc_id", ids).join(keys, "sha").select("doc_id", "item_id").distinct()


@register(
    _with(PR)
    + """SELECT number AS PR_Number, title AS Title, author AS Author, strftime(merged_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS Merged_At, printf('%.2f', coalesce(stateful.score, 0)) AS Stateful_Score, stateful.category AS Stateful_Category,
 coalesce(len(retrospective.strong_signals), 0)::INTEGER AS Strong_Signals_Count, coalesce(len(retrospective.medium_signals), 0)::INTEGER AS Medium_Signals_Count, coalesce(len(retrospective.weak_signals), 0)::INTEGER AS Weak_Signals_Count,
 printf('%.2f', coalesce(retrospective.summary_rank_score, 0)) AS Summary_Rank_Score, coalesce(len(changed_files), 0)::INTEGER AS Changed_Files_Count,
 coalesce(array_to_string(list_filter(changed_functions, lambda x: x IS NOT NULL), '; '), '') AS Changed_Functions, stateful.explanation AS Explanation FROM pr"""
)
def csv_lines(s: SparkSession, d: str) -> DataFrame:
    """Candidates as the CSV sink formats them."""
    return _records(s, d).select(*sinks.candidate_columns())


@register(
    _with(PR)
    + """SELECT DISTINCT repository, s.source_ref AS ref, CASE WHEN regexp_full_match(lower(s.source_ref), '[0-9a-f]{40}') THEN lower(s.source_ref) ELSE 'id-sha256-' || sha256(s.source_ref) END AS component FROM (SELECT repository, unnest(retrospective.weak_signals) AS s FROM pr) WHERE s.source_ref IS NOT NULL"""
)
def safe_component(s: SparkSession, d: str) -> DataFrame:
    ref = _records(s, d).select("original.repository", F.explode("retrospective.weak_signals").alias("x")).where("x.source_ref is not null").select("repository", F.col("x.source_ref").alias("ref"))
    safe = F.when(F.lower("ref").rlike(r"^[0-9a-f]{40}\z"), F.lower("ref")).otherwise(F.concat(F.lit("id-sha256-"), F.sha2("ref", 256)))
    return ref.select("repository", "ref", safe.alias("component")).distinct()


@register(
    _with(PR)
    + """SELECT repository, month, count(*) AS n FROM (SELECT repository, strftime(merged_at AT TIME ZONE 'UTC', '%Y-%m') AS month FROM pr WHERE merged_at IS NOT NULL) GROUP BY ALL"""
)
def monthly_slices(s: SparkSession, d: str) -> DataFrame:
    return _prs(s, d).where("merged_at is not null").groupBy("repository", F.date_format("merged_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@register()
def matched_pairs(s: SparkSession, d: str) -> DataFrame:
    """Greedy nearest matching of fixed with clean requests; sequential by nature, checked against brute force."""
    prs = _prs(s, d)
    r = _records(s, d).select("record_id", "original.repository", "original.number", F.col("stateful.score").alias("score"), F.col("stateful.category").alias("category"), records.tier().alias("tier")).where("tier in ('strong', 'none') and score is not null")
    size = records.sizes(prs).withColumn("size_band", paths.size_band(F.col("changed_lines")))
    rows = r.join(size, "record_id").join(records.primary_subsystem(prs), "record_id").withColumn("is_positive", F.col("tier") == "strong")
    return matching.pairs(rows.drop("record_id", "tier"), fallback=True)


# ----------------------------------------------------------- reports, lists, identity

REPORT = """rep AS (SELECT record_id, sub.subsystem, number, coalesce(stateful.score, 0)::DOUBLE AS score, coalesce(retrospective.summary_rank_score, 0)::DOUBLE AS rank, coalesce(len(retrospective.strong_signals), 0) AS strong, coalesce(len(retrospective.medium_signals), 0) AS medium,
 coalesce(len(retrospective.weak_signals), 0) AS weak, coalesce(len(changed_files), 0) AS files, coalesce(list_sum(list_transform(list_filter(changed_files, lambda f: f IS NOT NULL), lambda f: coalesce(f.additions, 0))), 0)::BIGINT AS additions,
 coalesce(list_sum(list_transform(list_filter(changed_files, lambda f: f IS NOT NULL), lambda f: coalesce(f.deletions, 0))), 0)::BIGINT AS deletions FROM pr JOIN sub USING (record_id))"""


@register(
    _with(PR, FILES, PRIMARY, REPORT)
    + """SELECT *, CASE WHEN strong > 0 THEN strong || ' strong' WHEN medium > 0 THEN medium || ' medium' WHEN weak > 0 THEN weak || ' weak' ELSE '-' END AS label FROM rep"""
)
def selection_report(s: SparkSession, d: str) -> DataFrame:
    """The rows of a selection report, in its order."""
    out = reports.rows(table(s, d, "pr_record"))
    label = reports.tier_label(F.col("strong"), F.col("medium"), F.col("weak")).alias("label")
    return reports.ordered(out).select("record_id", "subsystem", "number", "score", "rank", "strong", "medium", "weak", "files", "additions", "deletions", label)


@register(_with(PR, FILES, PRIMARY, REPORT) + "SELECT count(*) AS candidates, count(DISTINCT subsystem) AS subsystems, count(*)::BIGINT AS exportable, 0::BIGINT AS blocked FROM rep")
def report_totals(s: SparkSession, d: str) -> DataFrame:
    return reports.totals(reports.rows(table(s, d, "pr_record")))


@register(
    _with(PR, "sg AS (SELECT record_id, i AS pos, x.changed_paths AS ps FROM (SELECT record_id, unnest(retrospective.strong_signals) AS x, generate_subscripts(retrospective.strong_signals, 1) AS i FROM pr) WHERE x IS NOT NULL)")
    + f"""SELECT sg.record_id, sg.pos, coalesce(g.name, '(none)') AS subsystem FROM sg LEFT JOIN (SELECT DISTINCT ON (record_id, pos) record_id, pos, name FROM (SELECT record_id, pos, {SUBSYSTEM} AS name, count(*) AS n
   FROM (SELECT record_id, pos, string_split(p, '/') AS parts FROM (SELECT record_id, pos, unnest(ps) AS p FROM sg) WHERE p IS NOT NULL) GROUP BY ALL) ORDER BY record_id, pos, n DESC, name) g ON g.record_id = sg.record_id AND g.pos = sg.pos"""
)
def signal_subsystem(s: SparkSession, d: str) -> DataFrame:
    """The subsystem most paths of a strong signal belong to."""
    sg = _records(s, d).select("record_id", F.posexplode("retrospective.strong_signals").alias("at", "s")).where("s is not null")
    return sg.select("record_id", (F.col("at") + 1).cast("bigint").alias("pos"), paths.majority_group(F.col("s.changed_paths")).alias("subsystem"))


@register("SELECT field, outcome, count(*) AS n FROM field_decisions GROUP BY ALL")
def admission_counts(s: SparkSession, d: str) -> DataFrame:
    return admission.outcomes(table(s, d, "field_decisions"))


@register(
    _with(PR)
    + "SELECT record_id, coalesce(provenance.correlated_by <> '', false) AS counted, coalesce(len(retrospective.strong_signals), 0) > 0 AS strong, coalesce(len(retrospective.strong_signals), 0) + coalesce(len(retrospective.medium_signals), 0) > 0 AS strong_or_medium FROM pr"
)
def record_states(s: SparkSession, d: str) -> DataFrame:
    """Whether later commits were looked for, and whether a record counts as positive by either tier."""
    flags = [records.is_counted().alias("counted"), records.is_positive("strong").alias("strong"), records.is_positive("any").alias("strong_or_medium")]
    return table(s, d, "pr_record").where("original is not null").select("record_id", *flags).dropDuplicates(["record_id"])


LISTED = "ls AS (SELECT DISTINCT repository, unnest(fixing_pr_numbers) AS number FROM eval_keys)"


@register(_with(PR, LISTED) + "SELECT record_id, 'kept' AS side FROM pr SEMI JOIN ls USING (repository, number) UNION ALL SELECT record_id, 'dropped' FROM pr ANTI JOIN ls USING (repository, number)")
def listed_records(s: SparkSession, d: str) -> DataFrame:
    """Requests on the list of fixing requests, and those off it."""
    prs, members = _prs(s, d), _listed(s, d)
    on, off = (merging.listed(prs, members, ["repository", "number"], keep).select("record_id", F.lit(side).alias("side")) for keep, side in ((True, "kept"), (False, "dropped")))
    return on.unionByName(off)


@register(_with(PR, LISTED) + "SELECT repository, number FROM ls ANTI JOIN pr USING (repository, number) WHERE number IS NOT NULL")
def listed_absent(s: SparkSession, d: str) -> DataFrame:
    """Listed requests that the records lack."""
    return merging.absent(_prs(s, d), _listed(s, d), ["repository", "number"])


def _listed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_keys").select("repository", F.explode("fixing_pr_numbers").alias("number")).where("number is not null")


@register(
    """SELECT DISTINCT record_id, part FROM (SELECT a.record_id, unnest([CASE WHEN to_json(a.original)::VARCHAR <> to_json(b.original)::VARCHAR OR (a.original IS NULL) <> (b.original IS NULL) THEN 'original' END,
 CASE WHEN to_json(a.provenance)::VARCHAR <> to_json(b.provenance)::VARCHAR OR (a.provenance IS NULL) <> (b.provenance IS NULL) THEN 'provenance' END, CASE WHEN a.original.number IS DISTINCT FROM a.record_id THEN 'number' END]) AS part
 FROM pr_record a JOIN pr_record b ON a.record_id = b.record_id) WHERE part IS NOT NULL"""
)
def record_differences(s: SparkSession, d: str) -> DataFrame:
    """Deliveries of one record that are not the same record, and records whose number is not their id."""
    rows = table(s, d, "pr_record")
    first = rows.dropDuplicates(["record_id"])  # any that differ at all differ from this one
    unlike = merging.differences(first, rows, ["record_id"], {"original": "original", "provenance": "provenance"})
    other = merging.differences(first.selectExpr("record_id", "record_id AS n"), rows.selectExpr("record_id", "original.number AS n"), ["record_id"], {"number": "n"})
    return unlike.unionByName(other)


@register("SELECT record_id, CASE WHEN count(*) > 1 THEN 'more than once' END AS problem FROM pr_record WHERE record_id IS NOT NULL AND original IS NOT NULL GROUP BY record_id HAVING count(*) > 1")
def batch_coverage(s: SparkSession, d: str) -> DataFrame:
    """Deliveries held against records: what a concatenation of batches would hold twice, lack or add."""
    held = table(s, d, "pr_record").where("original is not null and record_id is not null")
    return merging.coverage(_records(s, d).where("record_id is not null"), held, ["record_id"])


@register(_with(CM) + f"SELECT repository, number, arg_min(sha, row(place, sha)) AS sha FROM (SELECT repository, sha, coalesce(place, 4611686018427387904) AS place, try_cast(regexp_extract(subject, {_quoted(Sql.MERGE_SUBJECT)}, 1) AS BIGINT) AS number FROM (SELECT cm.*, p.place FROM cm JOIN (SELECT repository, sha, min(log_idx) AS place FROM commits GROUP BY ALL) p USING (repository, sha))) WHERE number > 0 GROUP BY ALL")
def first_merges(s: SparkSession, d: str) -> DataFrame:
    """The first commit in the log that merges each request number."""
    rows = _commits(s, d).select("repository", "sha", F.coalesce("log_idx", F.lit(2**62)).alias("place"), F.regexp_extract("subject", refs.MERGE_SUBJECT, 1).try_cast("bigint").alias("number")).where("number > 0")
    return ranking.first_by(rows, ["repository", "number"], "sha", "place")


FORBIDDEN = """fb AS (SELECT DISTINCT record_id, value FROM (
 SELECT record_id, unnest([x.source_ref, x.raw_snippet]) AS value FROM (SELECT record_id, unnest(retrospective.strong_signals) AS x FROM pr) UNION ALL SELECT record_id, unnest([x.source_ref, x.context]) FROM (SELECT record_id, unnest(retrospective.medium_signals) AS x FROM pr)
 UNION ALL SELECT record_id, unnest([x.source_ref, x.context]) FROM (SELECT record_id, unnest(retrospective.weak_signals) AS x FROM pr) UNION ALL SELECT record_id, unnest([x.source_ref, x.analysis_note]) FROM (SELECT record_id, unnest(retrospective.commit_relationships) AS x FROM pr)
 UNION ALL SELECT record_id, unnest(x.lineage.matched_original_commit_shas) FROM (SELECT record_id, unnest(retrospective.commit_relationships) AS x FROM pr)) WHERE strlen(value) >= 7)"""


@register(_with(PR, FORBIDDEN) + "SELECT record_id, value FROM fb")
def forbidden_of_record(s: SparkSession, d: str) -> DataFrame:
    """Everything a record's later evidence would give away."""
    return keys.forbidden(_records(s, d))


@register(
    """WITH e AS (SELECT DISTINCT edit_id, repository, pr, diff FROM body_edits WHERE diff IS NOT NULL), n AS (SELECT *, lead(diff) OVER (PARTITION BY repository, pr ORDER BY edit_id) AS later FROM e),
 l AS (SELECT edit_id, 'a' AS side, unnest(string_split(diff, chr(10))) AS x FROM n WHERE later IS NOT NULL UNION ALL SELECT edit_id, 'b', unnest(string_split(later, chr(10))) FROM n WHERE later IS NOT NULL),
 t AS (SELECT edit_id, side, t FROM (SELECT edit_id, side, """
    + r"regexp_replace(x, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
    + """ AS t FROM l) WHERE NOT (t IN ('{', '}', '};', '()', '{}', '[]', '(', ')', ';', 'else', 'else {') OR starts_with(t, '//') OR starts_with(t, '/*') OR starts_with(t, '*') OR strlen(t) < 3)),
 c AS (SELECT edit_id, t, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM t GROUP BY ALL),
 g AS (SELECT edit_id, sum(a)::BIGINT AS added, sum(least(a, b))::BIGINT AS removed_again FROM c GROUP BY ALL)
 SELECT edit_id, added, removed_again, CASE WHEN added > 0 THEN removed_again / added::DOUBLE ELSE 0 END AS fraction, CASE WHEN n.diff = n.later THEN 'full' WHEN removed_again >= 2 THEN 'partial_candidate' ELSE 'none' END AS reversal_type FROM g JOIN n USING (edit_id)"""
)
def edit_reversals(s: SparkSession, d: str) -> DataFrame:
    """Reversal over made relations: each edit adds its lines, and the next one takes all of its own away."""
    own, later = _edit_pairs(s, d)
    lines = lambda x, kind: x.select("edit_id", F.lit(kind).alias("kind"), F.lit("text").alias("path"), F.explode(F.split("diff", "\n")).alias("content"))
    none = own.limit(0).select("edit_id", F.lit("text").alias("path"), F.lit("").alias("content"))
    digest = lambda x, name: x.select("edit_id", F.sha2("diff", 256).alias(name))
    out = diffs.reversal(lines(own, "+"), lines(later, "-"), none, ["edit_id"], digest(own, "original_patch").join(digest(later, "reverse_patch"), "edit_id"))
    return out.where("added + removed_again > 0 or reversal_type = 'full'").select("edit_id", "added", "removed_again", "fraction", "reversal_type")


@register()
def paired_cases(s: SparkSession, d: str) -> DataFrame:
    """Matched pairs with their ids in ascending positive number."""
    return ranking.pair_ids(matched_pairs(s, d), "positive", ["repository"])


# ----------------------------------------------------------- baselines and keys

HISTORY = f"""chg AS (SELECT repository, subsystem, happened, 1 AS commits, churn, CASE WHEN fixed THEN 1 ELSE 0 END AS defects FROM (SELECT repository, record_id, any_value(merged_at) AS happened, {SUBSYSTEM} AS subsystem, sum(coalesce(additions, 0) + coalesce(deletions, 0)) AS churn
   FROM (SELECT *, string_split(path, '/') AS parts FROM fl WHERE merged_at IS NOT NULL) GROUP BY ALL) JOIN (SELECT record_id, coalesce(len(retrospective.strong_signals), 0) > 0 AS fixed FROM pr) USING (record_id)),
cs AS (SELECT record_id AS case_id, repository, subsystem, merged_at AS cutoff FROM pr JOIN sub USING (record_id) WHERE merged_at IS NOT NULL),
tot AS (SELECT case_id, chg.subsystem, sum(commits) AS commits, sum(churn) AS churn, sum(defects) AS defects FROM cs JOIN chg ON cs.repository = chg.repository AND chg.happened < cutoff
   AND chg.happened >= (date_trunc('month', cutoff AT TIME ZONE 'UTC') - INTERVAL 24 MONTH + ((cutoff AT TIME ZONE 'UTC') - date_trunc('month', cutoff AT TIME ZONE 'UTC'))) AT TIME ZONE 'UTC' GROUP BY ALL),
act AS (SELECT *, ((rank() OVER d - 1) / count(*) OVER p::DOUBLE + cume_dist() OVER d) / 2 AS x, ((rank() OVER c - 1) / count(*) OVER p::DOUBLE + cume_dist() OVER c) / 2 AS y FROM (SELECT *, defects / commits::DOUBLE AS density FROM tot WHERE commits >= 2)
   WINDOW d AS (PARTITION BY case_id ORDER BY density), c AS (PARTITION BY case_id ORDER BY churn), p AS (PARTITION BY case_id)),
sco AS (SELECT *, round((x + y) / 2, 9) AS score FROM act),
ter AS (SELECT *, (rank() OVER (PARTITION BY case_id ORDER BY score) - 1) / count(*) OVER (PARTITION BY case_id)::DOUBLE AS share FROM sco)"""


@register(
    _with(PR, FILES, PRIMARY, HISTORY)
    + """SELECT cs.case_id, cs.subsystem, coalesce(tot.commits, 0)::BIGINT AS commits, coalesce(tot.churn, 0)::BIGINT AS churn, coalesce(tot.defects, 0)::BIGINT AS defects, coalesce(share >= 2/3::DOUBLE, false) AS risky, CASE WHEN coalesce(tot.commits, 0) = 0 THEN 'no_commits' WHEN tot.commits < 2 THEN 'low_activity' ELSE '' END AS reason
 FROM cs LEFT JOIN tot ON tot.case_id = cs.case_id AND tot.subsystem = cs.subsystem LEFT JOIN ter ON ter.case_id = cs.case_id AND ter.subsystem = cs.subsystem"""
)
def baseline_verdict(s: SparkSession, d: str) -> DataFrame:
    """Each request's subsystem against its repository's others in the two years before the merge.

    Windows are differences of running totals; two changes make a subsystem active here, as the
    test repositories are small.
    """
    prs = _prs(s, d)
    fixed = _records(s, d).select("record_id", F.when(records.count(F.col("retrospective.strong_signals")) > 0, 1).otherwise(0).alias("defects"))
    churn = F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    files = records.files(prs).where("merged_at is not null")
    changes = files.groupBy("repository", "record_id", paths.subsystem(F.col("path")).alias("subsystem")).agg(F.max("merged_at").alias("at"), F.sum(churn).alias("churn")).join(fixed, "record_id").withColumn("commits", F.lit(1))
    cases = prs.where("merged_at is not null").select(F.col("record_id").cast("string").alias("case_id"), "record_id", "repository", F.col("merged_at").alias("cutoff")).join(records.primary_subsystem(prs), "record_id")
    totals = baseline.window_totals(changes, cases.select("case_id", "repository", "cutoff"), ["repository", "subsystem"], ["commits", "churn", "defects"])
    out = baseline.verdicts(totals.drop("repository"), cases, min_commits=2)
    return out.select(F.col("case_id").cast("bigint").alias("case_id"), "subsystem", "commits", "churn", "defects", "risky", "reason")


@register(
    _with(PR)
    + """, sg AS (SELECT record_id, 'strong' AS tier, i AS pos, x.source_ref AS sha, x.signal_type AS matched_by FROM (SELECT record_id, unnest(retrospective.strong_signals) AS x, generate_subscripts(retrospective.strong_signals, 1) AS i FROM pr) WHERE x IS NOT NULL
 UNION ALL SELECT record_id, 'medium', i, x.source_ref, x.signal_type FROM (SELECT record_id, unnest(retrospective.medium_signals) AS x, generate_subscripts(retrospective.medium_signals, 1) AS i FROM pr) WHERE x IS NOT NULL)
 SELECT DISTINCT ON (record_id, sha) record_id, sha, tier, matched_by FROM sg WHERE regexp_full_match(sha, '[0-9a-f]{40}') ORDER BY record_id, sha, tier DESC, CASE WHEN tier = 'strong' THEN -pos ELSE pos END"""
)
def fixing_commits(s: SparkSession, d: str) -> DataFrame:
    return keys.fixing_commits(_records(s, d))


@register(
    _with(PR, CM)
    + f"""SELECT DISTINCT record_id, n AS number FROM (SELECT record_id, number AS own, try_cast(unnest(regexp_extract_all(full_message, {_quoted(Sql.NUMBER_REF)}, 1)) AS BIGINT) AS n FROM cm JOIN (
   SELECT DISTINCT record_id, repository, number, x.source_ref AS sha FROM (SELECT record_id, repository, number, unnest(retrospective.strong_signals) AS x FROM pr) WHERE x IS NOT NULL
   UNION SELECT DISTINCT record_id, repository, number, x.source_ref FROM (SELECT record_id, repository, number, unnest(retrospective.medium_signals) AS x FROM pr) WHERE x IS NOT NULL) f USING (repository, sha)) WHERE n > 0 AND n <> own"""
)
def issue_references(s: SparkSession, d: str) -> DataFrame:
    """Numbers that messages of the fixing commits refer to, less the request's own."""
    r = _records(s, d)
    own = r.select("record_id", "original.number")
    found = keys.texts(keys.fixing_commits(r), r, _commits(s, d))
    return keys.issues(found, own.limit(0), own)
