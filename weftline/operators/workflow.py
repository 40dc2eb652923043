"""Workflow files: YAML texts parsed into one nested column, and everything derived from it.

Parsing is the only Python step (Spark has no YAML reader); it runs once per row in Arrow batches.
Metrics, profiles and rules are expressions on the parsed column and stay in the JVM.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from weftline.functions.numbers import ratio

STEP = "struct<is_mapping: boolean, name: string, uses: string, run: string, has_if: boolean, continue_on_error: boolean, cache_key: string>"
JOB = (
    "struct<job_id: string, is_mapping: boolean, has_if: boolean, needs: array<string>, uses: string, runs_on: string, permissions_json: string, "
    f"has_timeout: boolean, matrix_dims: array<int>, matrix_include: int, matrix_exclude: int, has_matrix: boolean, steps: array<{STEP}>>"
)
DOCUMENT = (
    "struct<status: string, error: string, max_nesting_depth: int, full_depth: int, vertical_depth: int, cycle_depth: int, job_order: array<string>, events: array<string>, crons: array<string>, "
    f"on_json: string, permissions_json: string, concurrency_json: string, jobs: array<{JOB}>>"
)
_COLUMNS = ("status", "error", "max_nesting_depth", "full_depth", "vertical_depth", "cycle_depth", "job_order", "events", "crons", "on_json", "permissions_json", "concurrency_json", "jobs")


#: Nodes that a file may have once its aliases are written out.
MOST_NODES = 5_000_000


def _depths(root) -> tuple[int, int]:
    """Levels of nesting below a node: through mappings only, where a list counts as one level, and through lists too.

    Nodes that aliases share are visited once. ValueError where aliases form a cycle or stand for more
    than MOST_NODES nodes.
    """
    done: dict[int, tuple[int, int, int]] = {}  # levels through mappings, through all, nodes
    todo = [(root, False)]
    open_: set[int] = set()
    while todo:
        node, closing = todo.pop()
        inner = [x for x in (node.values() if isinstance(node, dict) else node) if isinstance(x, (dict, list))]
        if closing:
            open_.discard(id(node))
            found = [done[id(x)] for x in inner]
            below = max((d for d, _, _ in found), default=-1) if isinstance(node, dict) else -1
            size = len(node) + 1 + sum(n for _, _, n in found)
            if size > MOST_NODES:
                raise ValueError(f"aliases stand for more than {MOST_NODES} nodes")
            done[id(node)] = (below + 1, max((d for _, d, _ in found), default=-1) + 1, size)
        elif id(node) in open_:
            raise ValueError("aliases form a cycle")
        elif id(node) not in done:
            open_.add(id(node))
            todo.append((node, True))
            todo.extend((x, False) for x in inner)
    return done[id(root)][:2]


#: Levels of nesting that the parser, which is recursive, is given.
MOST_LEVELS = 5_000


def _too_deep(text: str, loader) -> bool:
    """Whether a text is nested deeper than MOST_LEVELS; read event by event, and only if it has signs enough for it."""
    import yaml

    if len(text) < 2 * MOST_LEVELS or sum(map(text.count, "[{-?")) < MOST_LEVELS and " " * MOST_LEVELS not in text:
        return False
    depth = 0
    for event in yaml.parse(text, Loader=loader):
        if isinstance(event, yaml.CollectionStartEvent):
            depth += 1
            if depth > MOST_LEVELS:
                return True
        elif isinstance(event, yaml.CollectionEndEvent):
            depth -= 1
    return False


def _needs(job) -> list[str]:
    needs = job.get("needs") if isinstance(job, dict) else None
    return [needs] if isinstance(needs, str) else [str(x) for x in needs] if isinstance(needs, list) else []


def job_order(needs: dict[str, list[str]]) -> list[str]:
    """The jobs in file order, each behind those it needs; a job of a cycle comes where it is met first."""
    out, seen = [], set()
    for first in needs:
        todo = [(first, iter(needs[first]))] if first not in seen else []
        seen.add(first)
        while todo:
            at, rest = todo[-1]
            following = next((x for x in rest if x in needs and x not in seen), None)
            if following is None:
                out.append(at)
                todo.pop()
            else:
                seen.add(following)
                todo.append((following, iter(needs[following])))
    return out


#: Jobs of a tangle (jobs that all lie on cycles with each other) whose walks are tried one by one.
TANGLE = 10


def _tangles(needs: dict[str, list[str]]) -> list[list[str]]:
    """The jobs in groups that reach each other, those that are needed first; one by one where there is no cycle."""
    number: dict[str, int] = {}
    least: dict[str, int] = {}
    held: list[str] = []
    inside: set[str] = set()
    out = []
    for first in needs:
        if first in number:
            continue
        todo = [(first, iter(needs[first]))]
        number[first] = least[first] = len(number)
        held.append(first)
        inside.add(first)
        while todo:
            at, rest = todo[-1]
            for x in rest:
                if x not in needs:
                    continue
                if x not in number:
                    number[x] = least[x] = len(number)
                    held.append(x)
                    inside.add(x)
                    todo.append((x, iter(needs[x])))
                    break
                if x in inside:
                    least[at] = min(least[at], number[x])
            else:
                todo.pop()
                if todo:
                    least[todo[-1][0]] = min(least[todo[-1][0]], least[at])
                if least[at] == number[at]:
                    group = []
                    while not group or group[-1] != at:
                        group.append(held.pop())
                    inside.difference_update(group)
                    out.append(group)
    return out


def chain_depth(needs: dict[str, list[str]], in_cycle: int = 0) -> int:
    """The number of jobs on the longest chain of needs; unknown jobs do not count, and meeting a job
    of the chain again counts `in_cycle`.

    Linear, but for jobs on cycles: in a tangle of up to TANGLE jobs every walk is tried; of a larger
    one, whose longest walk cannot be found in reasonable time, all jobs count, which no walk exceeds.
    """
    depth: dict[str, int] = {}
    for group in _tangles(needs):
        own = set(group)
        below = {j: max((depth[x] for x in needs[j] if x in depth), default=0) for j in group}
        if len(group) == 1:
            (j,) = group
            depth[j] = 1 + max(below[j], in_cycle if j in needs[j] else 0)
        elif len(group) > TANGLE:
            depth.update(dict.fromkeys(group, len(group) + max(in_cycle, *below.values())))
        else:
            inner = {j: [x for x in needs[j] if x in own] for j in group}

            def walk(j: str, seen: frozenset) -> int:
                return 1 + max([below[j], *(in_cycle if x in seen else walk(x, seen | {x}) for x in inner[j])])  # noqa: B023

            depth.update({j: walk(j, frozenset({j})) for j in group})
    return max(depth.values(), default=0)


def _events(on) -> tuple[list[str], list[str]]:
    names = [on] if isinstance(on, str) else list(on) if isinstance(on, (list, dict)) else []
    schedule = on.get("schedule") if isinstance(on, dict) else None
    crons = [str(x["cron"]) for x in schedule if isinstance(x, dict) and "cron" in x] if isinstance(schedule, list) else []
    return sorted({str(x).strip().lower() for x in names}), crons


def _text(x) -> str | None:
    return None if x is None else x if isinstance(x, str) else str(x)


def _step(step) -> dict:
    if not isinstance(step, dict):
        return {"is_mapping": False, "name": None, "uses": None, "run": None, "has_if": False, "continue_on_error": False, "cache_key": None}
    uses, given = step.get("uses"), step.get("with")
    if uses is not None and not isinstance(uses, str):
        raise TypeError("uses is no text")
    key = given.get("key") if isinstance(given, dict) else None
    return {"is_mapping": True, "name": _text(step.get("name")), "uses": uses, "run": _text(step.get("run")), "has_if": "if" in step, "continue_on_error": step.get("continue-on-error") is True, "cache_key": _text(key)}


def _job(name, job) -> dict:
    out = dict.fromkeys(("uses", "runs_on", "permissions_json"))
    out |= {"job_id": str(name), "is_mapping": isinstance(job, dict), "has_if": False, "needs": _needs(job), "has_timeout": False, "matrix_dims": [], "matrix_include": 0, "matrix_exclude": 0, "has_matrix": False, "steps": []}
    if not isinstance(job, dict):
        return out
    steps = job.get("steps", [])
    if steps is None:
        raise TypeError("steps is empty")
    strategy = job.get("strategy")
    matrix = strategy.get("matrix") if isinstance(strategy, dict) else None
    if isinstance(matrix, dict) and matrix:
        size = lambda k: len(matrix[k]) if isinstance(matrix.get(k), list) else 0
        out |= {"has_matrix": True, "matrix_include": size("include"), "matrix_exclude": size("exclude"), "matrix_dims": [len(v) for k, v in matrix.items() if k not in ("include", "exclude") and isinstance(v, list)]}
    return out | {
        "has_if": "if" in job, "uses": _text(job.get("uses")), "runs_on": _text(job.get("runs-on")), "has_timeout": "timeout-minutes" in job,
        "permissions_json": json.dumps(job["permissions"], default=str) if "permissions" in job else None, "steps": [_step(s) for s in steps] if isinstance(steps, list) else [],
    }


def parse_document(text: str | None) -> dict:
    """One workflow file. status: ok, empty, parse_error, not_mapping, missing_jobs or extract_error.

    A key `on` counts however YAML 1.1 reads it.
    """
    import yaml

    out = dict.fromkeys(_COLUMNS)
    if not text or not text.strip():
        return out | {"status": "empty"}
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        if _too_deep(text, loader):
            raise ValueError(f"nested deeper than {MOST_LEVELS} levels")
        doc = yaml.load(text, Loader=loader)
    except Exception as error:  # whatever the parser meets, the file is set aside
        return out | {"status": "parse_error", "error": str(error)}
    if not isinstance(doc, dict):
        return out | {"status": "not_mapping", "error": f"top level is {type(doc).__name__}"}
    jobs = doc.get("jobs")
    if not isinstance(jobs, dict):
        return out | {"status": "missing_jobs", "error": "no mapping of jobs"}
    try:
        shallow, deep = _depths(doc)  # first, as it refuses what cannot be walked
        on = doc.get("on", doc.get(True))
        events, crons = _events(on)
        needs = {str(k): _needs(v) for k, v in jobs.items()}
        dump = lambda k: json.dumps(doc[k], default=str) if k in doc else None
        return out | {
            "status": "ok", "max_nesting_depth": shallow, "full_depth": deep, "vertical_depth": chain_depth(needs), "cycle_depth": chain_depth(needs, 1), "job_order": job_order(needs),
            "events": events, "crons": crons, "on_json": json.dumps(on, default=str) if on is not None else None, "permissions_json": dump("permissions"), "concurrency_json": dump("concurrency"),
            "jobs": [_job(k, v) for k, v in jobs.items()],
        }
    except Exception as error:
        return out | {"status": "extract_error", "error": f"{type(error).__name__}: {error}"}


def parsed(text: Column) -> Column:
    """The parsed document of a YAML text."""

    kind = to_arrow_type(_parse_datatype_string(DOCUMENT))

    @F.arrow_udf(DOCUMENT)
    def parse(texts: pa.Array) -> pa.Array:
        return pa.array([parse_document(t.as_py()) for t in texts], kind)

    # not to be evaluated again where a filter on the result is pushed down
    return parse.asNondeterministic()(text)


def prepared(files: DataFrame, doc: str = "doc") -> DataFrame:
    """`files` with the arrays that metrics, profile and rules share: _jobs (mappings only), _steps, _uses."""
    jobs = files.withColumn("_jobs", F.expr(f"filter({doc}.jobs, j -> j.is_mapping)"))
    steps = jobs.withColumn("_steps", F.expr("flatten(transform(_jobs, j -> j.steps))"))
    return steps.withColumn("_uses", F.expr("filter(transform(_steps, s -> s.uses), u -> u is not null)"))


def line_count(text: Column) -> Column:
    """Lines of a text under any line ends; a last line without an end counts, an empty text has none."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    feeds = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
    return F.when(F.length(plain) == 0, 0).otherwise(feeds + F.when(plain.endswith("\n"), 0).otherwise(1))


def escaped(text: Column) -> Column:
    """A text in one line: backslashes, line feeds and carriage returns written out."""
    out = text
    for plain, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(shown))
    return out


def unescaped(text: Column) -> Column:
    """Undoes escaped().

    Between doubled backslashes no backslash stands for itself, so the parts are undone one by one.
    """
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.when(text.isNotNull(), F.array_join(plain, "\\"))


def metrics(doc: str, text: str) -> dict[str, Column]:
    """The metrics of a parsed document (column `doc`, status ok) of prepared() files by name."""
    jobs, steps, uses = "_jobs", "_steps", "_uses"
    local = f"array_distinct(filter({uses}, u -> u like './%' or left(u, 2) = concat('.', chr(92))))"
    external = f"array_distinct(transform(filter({uses}, u -> not (u like './%' or left(u, 2) = concat('.', chr(92))) and contains(u, '/')), u -> substring_index(u, '@', 1)))"
    reusable = f"array_distinct(filter(transform({jobs}, j -> j.uses), u -> u is not null))"
    combos = "greatest(0, aggregate(j.matrix_dims, 1, (a, d) -> a * d) + j.matrix_include - j.matrix_exclude)"
    e = F.expr
    num = {
        "lines_of_yaml": line_count(F.col(text)),
        "num_jobs": e(f"size({jobs})"),
        "num_steps": e(f"size({steps})"),
        "max_nesting_depth": F.col(f"{doc}.max_nesting_depth"),
        "job_parallelism": e(f"size({doc}.jobs)"),
        "max_sequential_steps": e(f"coalesce(array_max(transform({jobs}, j -> size(j.steps))), 0)"),
        "vertical_depth": F.col(f"{doc}.vertical_depth"),
        "matrix_size": e(f"aggregate(filter({jobs}, j -> size(j.matrix_dims) > 0), 0, (t, j) -> t + {combos})"),
        "num_conditionals": e(f"size(filter({jobs}, j -> j.has_if)) + size(filter({steps}, s -> s.has_if))"),
        "num_job_dependencies": e(f"aggregate({jobs}, 0, (t, j) -> t + size(j.needs))"),
        "num_reusable_workflows": e(f"size({reusable})"),
        "num_unique_external_actions": e(f"size({external})"),
        "num_local_actions": e(f"size({local})"),
        "num_marketplace_actions": e(f"size(filter({external}, u -> length(u) - length(replace(u, '/', '')) = 1 and u not like 'actions/%'))"),
    }
    flags = {
        "has_matrix": e(f"exists({jobs}, j -> j.has_matrix)"),
        "has_conditionals": num["num_conditionals"] > 0,
        "has_job_dependencies": num["num_job_dependencies"] > 0,
        "uses_reusable_workflows": num["num_reusable_workflows"] > 0,
        "uses_external_actions": num["num_unique_external_actions"] > 0,
        "uses_local_actions": num["num_local_actions"] > 0,
    }
    ratios = {
        "avg_steps_per_job": ratio(num["num_steps"], num["num_jobs"], 2),
        "dependency_ratio": ratio(num["num_job_dependencies"], num["num_jobs"], 3),
        "external_action_diversity": ratio(num["num_unique_external_actions"], num["num_steps"], 3),
        "conditional_density": ratio(num["num_conditionals"], num["num_jobs"] + num["num_steps"], 3),
    }
    return num | ratios | flags


def pin_kind(uses: str) -> str:
    """SQL for how a `uses` (an expression) is pinned: sha, tag, branch or unpinned, by all that follows its first @ but for blanks around it."""
    ref = f"trim(substring({uses}, locate('@', {uses}) + 1))"
    return (
        f"case when not contains({uses}, '@') then 'unpinned' when {ref} rlike '^(?i)[0-9a-f]{{40}}$' then 'sha' when {ref} rlike '^(?i)v[0-9][A-Za-z0-9_.-]*$' then 'tag' "
        f"when {ref} rlike '^[A-Za-z][A-Za-z0-9_./-]*$' then 'branch' else 'unpinned' end"
    )


def profile(doc: str) -> dict[str, Column]:
    """The profile of a parsed document of prepared() files: events, caches, modularity, pins, commands."""
    jobs, steps, uses = "_jobs", "_steps", "_uses"
    called = f"filter(transform({jobs}, j -> j.uses), u -> u is not null)"
    caches = f"filter({steps}, s -> contains(lower(s.uses), 'actions/cache'))"
    keys = f"filter(transform({caches}, s -> trim(s.cache_key)), k -> k <> '')"
    pinned = f"array_distinct(filter(transform({uses}, u -> trim(u)), u -> u not like './%'))"
    e = F.expr
    out = {
        "events": e(f"array_join({doc}.events, ', ')"),
        "num_events": e(f"size({doc}.events)"),
        "schedule_pattern": e(f"array_join({doc}.crons, ' | ')"),
        **{f"has_{k}": e(f"cast(array_contains({doc}.events, '{k}') as int)") for k in ("push", "pull_request", "schedule", "workflow_dispatch")},
        "dependency_depth": F.col(f"{doc}.cycle_depth"),
        "uses_cache": e(f"cast(size({caches}) > 0 as int)"),
        "cache_count": e(f"size({caches})"),
        "num_cache_keys": e(f"size({keys})"),
        "cache_keys": e(f"array_join({keys}, ' | ')"),
        "reusable_workflow_count": e(f"size(filter({called}, u -> contains(u, '.github/workflows') or contains(u, '@')))"),
        "local_action_count": e(f"size(filter({uses}, u -> u like './%'))"),
        "composite_action_count": e(f"size(filter({uses}, u -> u not like './%' and contains(lower(u), '.github/actions')))"),
        "has_chained_commands": e(f"cast(exists({steps}, s -> coalesce(s.run rlike '&&|;', false)) as int)"),
        "external_actions_count": e(f"size({pinned})"),
        "total_actions": e(f"size({pinned})"),
    }
    counts = {"uses_reusable_workflows": "reusable_workflow_count", "uses_composite_actions": "composite_action_count", "uses_local_actions": "local_action_count"}
    out |= {flag: (out[count] > 0).cast("int") for flag, count in counts.items()}
    out["total_modularity_constructs"] = sum((out[c] for c in counts.values()), F.lit(0))
    for kind, column in (("sha", "pinned_to_sha"), ("tag", "pinned_to_tag"), ("branch", "pinned_to_branch"), ("unpinned", "unpinned")):
        out[column] = e(f"size(filter({pinned}, u -> {pin_kind('u')} = '{kind}'))")
        out[f"{kind}_percentage"] = F.round(100 * ratio(out[column], out["total_actions"]), 1)
    return out


def complexity(doc: str) -> dict[str, Column]:
    """What a sampling frame keeps of a parsed document of prepared() files: jobs, steps, actions, commands, matrices, conditions.

    num_jobs counts all jobs, num_steps only steps that are mappings.
    """
    jobs, steps = "_jobs", "filter(_steps, s -> s.is_mapping)"
    e = F.expr
    return {
        "num_jobs": e(f"size({doc}.jobs)"),
        "num_steps": e(f"size({steps})"),
        "max_steps_per_job": e(f"coalesce(array_max(transform({jobs}, j -> size(j.steps))), 0)"),
        "num_actions_used": e("size(_uses)"),
        "num_run_commands": e(f"size(filter({steps}, s -> s.run is not null))"),
        "num_unique_actions": e("size(array_distinct(transform(_uses, u -> substring_index(u, '@', 1))))"),
        "has_matrix": e(f"exists({jobs}, j -> j.has_matrix)"),
        "has_conditions": e(f"exists({jobs}, j -> j.has_if) or exists({steps}, s -> s.has_if)"),
        "job_names": e(f"array_join(transform({doc}.jobs, j -> j.job_id), ', ')"),
    }


def step_name(step: str) -> str:
    """SQL for what a step (an expression) is called: its name, its action without version, or the first line of its command up to 60 characters."""
    first = f"split(regexp_replace({step}.run, '^\\\\s+|\\\\s+$', ''), '\\r\\n?|\\n')[0]"
    return (
        f"case when not {step}.is_mapping then 'unknown' when {step}.name <> '' then trim({step}.name) when {step}.uses is not null then trim(substring_index({step}.uses, '@', 1)) "
        f"when {step}.run is not null then concat(left({first}, 60), case when length({first}) > 60 then '...' else '' end) else 'unnamed_step' end"
    )


def project_of(path: Column) -> Column:
    """owner/repo of a path with a folder owner@repo; null without one."""
    found = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"(?:^|/)([^/@]+@[^/]+)/", 1)
    return F.when(found != "", F.regexp_replace(found, "@", "/"))


def workflow_order(rows: DataFrame, project: str, path: str, preferred: Iterable[str]) -> DataFrame:
    """Adds workflows_in_project and keeps one row per project: the most preferred file name, then the first path."""
    name = F.lower(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, preferred)), name), F.lit(0))
    order = F.struct(F.when(rank == 0, 100).otherwise(rank), F.col(path))
    picked = rows.groupBy(project).agg(F.min_by(F.struct(*(F.col(c) for c in rows.columns)), order).alias("r"), F.count("*").alias("workflows_in_project"))
    return picked.select("r.*", "workflows_in_project")
