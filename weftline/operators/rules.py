"""Rules over workflow files: conditions on the parsed document and its text, scored and ranked."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.workflow import prepared, step_name


class Rule(NamedTuple):
    """A rule holds for a file where `condition` (SQL on `doc` and `text`) does; evidence is SQL for what shows it, explanation says what it means."""

    rule_id: str
    name: str
    category: str
    severity: int
    explanation: str
    condition: str
    evidence: str = "''"
    enabled: bool = True


# What the published rules look for.
INSTALLS = ("pip install", "pip3 install", "mvn install", "gradle build", "apt-get install", "npm install", "yarn install", "conan install", "vcpkg install")
CACHES = ("actions/cache", "cache:")
BRANCHES = ("main", "master", "HEAD", "develop", "dev")
FIRST_PARTIES = ("actions/", "github/")
MOVING_RUNNERS = ("ubuntu-latest", "windows-latest", "macos-latest")
TRIGGERS = ("push", "pull_request", "pull_request_target")
SECRET = r"[$][{][{]\\s*secrets[.][A-Za-z0-9_]+\\s*[}][}]"
EVENT = r"[$][{][{]\\s*github[.]event[.][A-Za-z0-9_.]+\\s*[}][}]"
VERSION = "v[0-9]+([.][0-9]+)*"
IMAGE = r"image:\\s*[a-zA-Z0-9/_.-]+:(latest|[0-9]+([.][0-9]+)?)\\b"

_JOBS, _STEPS = "_jobs", "_steps"
_SQL = lambda values: ", ".join(f"'{v}'" for v in values)


def _found(pattern: str) -> str:
    return f"array_join(flatten(transform({_STEPS}, s -> regexp_extract_all(coalesce(s.run, ''), '{pattern}', 0))), '; ')"


def _lines(condition: str) -> str:
    return f"filter(split(text, '\\n'), l -> {condition})"


def _actions(condition: str) -> str:
    """The uses of steps that are owner/name@ref and meet a condition on u and ref."""
    whole = "size(split(u, '@')) = 2 and locate('/', u) > 1 and locate('/', u) < locate('@', u) - 1"
    return f"filter(transform(_uses, x -> trim(x)), u -> {whole} and ({condition.format(ref=chr(40) + 'substring_index(u, ' + repr('@') + ', -1)' + chr(41))}))"


def _several(array: str) -> str:
    return f"array_join({array}, '; ')"


_BRANCHED = _actions(f"{{ref}} in ({_SQL(BRANCHES)})")
_TAGGED = _actions("{ref} rlike '^" + VERSION + "$' and not " + " and not ".join(f"startswith(u, '{p}')" for p in FIRST_PARTIES))
_INSTALL = "(?i)(" + "|".join(INSTALLS) + ")"
_CACHE = "(?i)(" + "|".join(CACHES) + ")"
_MOVING = f"filter({_JOBS}, j -> exists(array({_SQL(MOVING_RUNNERS)}), x -> contains(lower(j.runs_on), x)))"
#: Carried over the lines of a file: whether a cache step was met, and the keys without a hash.
CACHE_KEYS = (
    "aggregate(split(text, '\\n'), named_struct('open', false, 'keys', cast(array() as array<string>)), (a, l) -> named_struct("
    "'open', (a.open or contains(l, 'actions/cache')) and not (l rlike '(?i)key:[ \\t]*[^ \\t\\r]'), "
    "'keys', case when (a.open or contains(l, 'actions/cache')) and l rlike '(?i)key:[ \\t]*[^ \\t\\r]' and not (regexp_extract(l, '(?i)key:[ \\t]*(.+)', 1) rlike '(?i)hashFiles[(]') "
    "then array_append(a.keys, trim(regexp_extract(l, '(?i)key:[ \\t]*(.+)', 1))) else a.keys end), a -> a.keys)"
)
_UNTIMED = f"filter({_JOBS}, j -> not j.has_timeout)"
_IGNORED = f"filter({_STEPS}, s -> s.continue_on_error)"
_WIDE = "coalesce({0} = '\"write-all\"' or exists(map_values(from_json({0}, 'map<string,string>')), v -> v = 'write'), false)"
_UNNOTED = _lines('l like "%uses:%" and l rlike "@[0-9a-f]{40}" and not (l rlike "@[0-9a-f]{40}[ \\t]*#")')
_UNFIXED = _lines(f'l rlike "{IMAGE}"')
_AT = lambda trigger, key="": f"get_json_object(doc.on_json, concat('$.', {trigger}{', ' + repr('.' + key) if key else ''}))"
_PATHLESS = f"filter(array('push', 'pull_request'), t -> left({_AT('t')}, 1) = '{{{{' and {_AT('t', 'paths')} is null and {_AT('t', 'paths-ignore')} is null)".replace("{{", "{")

RULES = (
    Rule("SEC-01", "Secret written into a command", "Security", 5, "The shell and its logs see the value; pass it as an environment variable.", f"exists({_STEPS}, s -> coalesce(s.run rlike '{SECRET}', false))", _found(SECRET)),
    Rule("SEC-02", "No permissions", "Security", 5, "The token of the run may get every right the repository grants by default.", f"doc.permissions_json is null and not exists({_JOBS}, j -> j.permissions_json is not null)"),
    Rule("SEC-03", "Action pinned to a branch", "Security", 5, "Whatever is pushed to the branch runs here, without any change of version.", f"size({_BRANCHED}) > 0", _several(_BRANCHED)),
    Rule("VER-01", "Moving runner label", "Versioning", 3, "The machine changes when its label is moved.", f"size({_MOVING}) > 0", f"array_join(transform({_MOVING}, j -> j.job_id), ', ')"),
    Rule("REL-01", "Job without time limit", "Reliability", 3, "A job that hangs blocks its runner for hours.", f"size({_UNTIMED}) > 0", f"array_join(transform({_UNTIMED}, j -> j.job_id), ', ')"),
    Rule("REL-02", "Failures ignored", "Reliability", 4, "A step may fail while its run counts as a success.", f"size({_IGNORED}) > 0", f"array_join(transform({_IGNORED}, s -> coalesce(s.name, s.uses, 'unnamed')), '; ')"),
    Rule("WA-01", "Privileged trigger", "Workflow Activator", 5, "Code of forks runs with the rights and secrets of the repository.", "array_contains(doc.events, 'pull_request_target') and coalesce(doc.permissions_json in ('\"write-all\"', '{}', 'null', '[]', '\"\"'), true)"),
    Rule("EFF-01", "Installs without cache", "Efficiency", 3, "Every run downloads its dependencies again.", f"text rlike '{_INSTALL}' and not (text rlike '{_CACHE}')", f"array_join(array_distinct(regexp_extract_all(text, '{_INSTALL}', 0)), ', ')"),
    Rule("EFF-02", "Cache key without hash", "Efficiency", 3, "The cache is never renewed.", f"size({CACHE_KEYS}) > 0", f"array_join({CACHE_KEYS}, '; ')"),
    Rule("MAINT-01", "Long and not reused", "Maintainability", 3, "Many steps that no other workflow can share.", f"size({_STEPS}) > 15 and not array_contains(doc.events, 'workflow_call') and not exists(_uses, u -> contains(u, '.github/workflows'))", f"cast(size({_STEPS}) as string)"),
    # known, but not part of the score
    Rule("D1", "Broad permissions", "Security", 4, "More rights than the jobs need.", f"{_WIDE.format('doc.permissions_json')} or exists({_JOBS}, j -> {_WIDE.format('j.permissions_json')})", enabled=False),
    Rule("D2", "Event text in a command", "Security", 5, "Whoever opens an issue or branch can write commands.", f"exists({_STEPS}, s -> coalesce(s.run rlike '{EVENT}', false))", _found(EVENT), False),
    Rule("D3", "Foreign action pinned to a tag", "Security", 3, "The tag can be moved to other code.", f"size({_TAGGED}) > 0", _several(_TAGGED), False),
    Rule("D4", "Commit without version note", "Versioning", 1, "Nobody sees which version the commit is.", f"size({_UNNOTED}) > 0", _several(f"transform(slice({_UNNOTED}, 1, 3), l -> trim(l))"), False),
    Rule("D5", "Moving image tag", "Versioning", 3, "The image changes under the same tag.", f"size({_UNFIXED}) > 0", _several(f"transform(slice({_UNFIXED}, 1, 3), l -> trim(l))"), False),
    Rule("D6", "No concurrency", "Reliability", 2, "Runs of the same branch pile up.", f"arrays_overlap(doc.events, array({_SQL(TRIGGERS)})) and doc.concurrency_json is null", f"array_join(array_intersect(doc.events, array({_SQL(TRIGGERS)})), ', ')", False),
    Rule("D7", "Concurrency without cancelling", "Reliability", 2, "Outdated runs go on.", "left(doc.concurrency_json, 1) = '{' and coalesce(get_json_object(doc.concurrency_json, '$.cancel-in-progress'), 'false') = 'false'", enabled=False),
    Rule("D8", "Push without filter", "Workflow Activator", 2, "Every branch and tag starts a run.", f"array_contains(doc.events, 'push') and {_AT(repr('push'), 'branches')} is null and {_AT(repr('push'), 'tags')} is null", enabled=False),
    Rule("D9", "No path filter", "Workflow Activator", 2, "Changes of any file start a run.", f"size({_PATHLESS}) > 0", f"array_join({_PATHLESS}, ', ')", False),
    Rule("D10", "One long job", "Efficiency", 2, "Nothing runs in parallel.", f"size(doc.jobs) = 1 and size({_STEPS}) >= 6", f"array_join(transform({_STEPS}, s -> {step_name('s')}), '; ')", False),
)


def justifiable(rule_id: Column, language: Column) -> Column:
    """no, unless policy, or possibly: whether a violation can be meant."""
    never = rule_id.isin("SEC-01", "SEC-03", "WA-01") | ((rule_id == "VER-01") & (language == "C++")) | ((rule_id == "REL-01") & language.isin("Java", "C++")) | ((rule_id == "EFF-01") & language.isin("Java", "Python"))
    return F.when(rule_id == "SEC-02", "unless policy").when(F.coalesce(never, F.lit(False)), "no").otherwise("possibly")


def evaluate(files: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES, enabled_only: bool = True) -> DataFrame:
    """keys, status, rule_id, name, category, severity, violation (0, 1, null for a file that does not parse), outcome, evidence, explanation.

    files: keys, doc (parsed), text. One pass: all rules of a file come out of one row. outcome is
    violation, compliant or PARSE_ERROR. No condition can fail at run time: where one does not apply,
    it is null and counts as met.
    """
    used = [r for r in rules if r.enabled or not enabled_only]
    ok = F.col("doc.status") == "ok"
    rows = [
        F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("name"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"),
            F.when(ok, F.coalesce(F.expr(r.condition), F.lit(False)).cast("int")).alias("violation"),
            F.when(~ok, "PARSE_ERROR").when(F.expr(r.condition), "violation").otherwise("compliant").alias("outcome"),
            F.when(ok & F.expr(r.condition), F.expr(r.evidence)).alias("evidence"),
            F.when(ok & F.expr(r.condition), r.explanation).alias("explanation"),
        )
        for r in used
    ]
    return prepared(files).select(*keys, F.col("doc.status").alias("status"), F.inline(F.array(*rows)))


def scores(detail: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, total_violations, weighted_severity, compliance_score (1 - weight / all severities; 0 for a file that does not parse), categories_violated."""
    hit = F.col("violation") == 1
    out = detail.groupBy(*keys, "status").agg(
        F.count_if(hit).alias("total_violations"),
        F.sum(F.when(hit, F.col("severity")).otherwise(0)).alias("weighted_severity"),
        F.sum("severity").alias("worst"),
        F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("category")))), ", ").alias("categories_violated"),  # at most one per rule
    )
    score = F.when(F.col("status") == "ok", F.round(1 - F.col("weighted_severity") / F.col("worst"), 4)).otherwise(0.0)
    return out.select(*keys, "status", "total_violations", "weighted_severity", score.alias("compliance_score"), "categories_violated")


def ranking(detail: DataFrame) -> DataFrame:
    """rank, rule_id, name, category, severity, violations, total_checked, prevalence_pct, risk_score."""
    from pyspark.sql import Window

    sums = detail.groupBy("rule_id", "name", "category", "severity").agg(F.count_if(F.col("violation") == 1).alias("violations"), F.count("violation").alias("total_checked"))
    part = F.coalesce(F.round(100.0 * F.col("violations") / F.nullif(F.col("total_checked"), F.lit(0)), 1), F.lit(0.0))
    rated = sums.withColumn("prevalence_pct", part).withColumn("risk_score", F.round(F.col("severity") * F.col("prevalence_pct") / 100, 3))
    # one row per rule
    return rated.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("risk_score"), "rule_id")))


def violation_matrix(detail: DataFrame, keys: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per file with a 0/1 column per rule; 0 where a file was not checked."""
    ids = [r.rule_id for r in rules if r.enabled]
    wide = detail.groupBy(*keys).agg(*(F.coalesce(F.max(F.when(F.col("rule_id") == i, F.col("violation"))), F.lit(0)).alias(i.replace("-", "_")) for i in ids))
    return wide
