"""Join operators: attribution, merges, history, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions.calendar import epoch_ms
from quillmeter.functions.text import ancestors, comparable_key, git_remote, key_segments, moved_below, parent_key, project_key, without_end_separators
from quillmeter.operators.dedupe import content_hash
from quillmeter.operators.windows import BLOCK_MS, HOUR_MS


def session_roots(usage: DataFrame) -> DataFrame:
    """(source, session_id, root): the directory of a session's earliest row that has one, the smaller on a tie."""
    first = F.min(F.when(F.col("repo_root").isNotNull(), F.struct("ts", "repo_root")))
    return usage.groupBy("source", "session_id").agg(first["repo_root"].alias("root"))


def attribute_nearest_root(usage: DataFrame) -> DataFrame:
    """usage whose repo_root moves to the nearest directory, up to its session's root, where a session started.

    Distinct pairs of project and session root are few; each is walked up once, and the result is
    joined back on the pair. Windows paths are compared without case, with either separator; of
    two spellings of a start the smaller one names it.
    """
    roots = session_roots(usage).withColumn("root", project_key(F.col("root")))
    keyed = usage.join(roots, ["source", "session_id"], "left").withColumn("_key", project_key(F.col("repo_root")))
    pairs = keyed.where("_key is not null and root is not null and _key <> root").select("_key", "root").distinct()
    up = pairs.select("_key", "root", F.posexplode(ancestors(F.col("_key"))).alias("depth", "_at")).withColumn("candidate", comparable_key(F.col("_at")))
    below = F.max(F.when(F.col("candidate") == comparable_key(F.col("root")), F.col("depth"))).over(Window.partitionBy("_key", "root"))
    walk = up.withColumn("_end", below).where("_end is not null and depth <= _end")
    starts = roots.where("root is not null").groupBy(comparable_key(F.col("root")).alias("candidate")).agg(F.min("root").alias("_start"))
    nearest = walk.join(starts, "candidate").groupBy("_key", "root").agg(F.min_by("_start", "depth").alias("_to"))
    moved = keyed.join(nearest, ["_key", "root"], "left")
    return moved.withColumn("repo_root", F.coalesce("_to", "repo_root")).select(*usage.columns)


def move_by_aliases(usage: DataFrame, aliases: DataFrame) -> DataFrame:
    """usage whose project moves below the target of its nearest alias(alias, target); moves don't chain.

    A target that is nearer than any alias keeps the project where it is.
    """
    keys = usage.select(project_key(F.col("repo_root")).alias("k")).where("k is not null").distinct()
    walk = keys.select("k", F.posexplode(ancestors(F.col("k"))).alias("depth", "above")).withColumn("at", comparable_key(F.col("above")))
    ends = aliases.select(comparable_key(F.col("alias")).alias("at"), "target").unionByName(aliases.select(comparable_key(F.col("target")).alias("at"), F.lit(None).cast("string").alias("target")).distinct())
    nearest = walk.join(ends, "at").groupBy("k").agg(F.min(F.struct("depth", F.col("target").isNotNull().alias("_a"), "above", "target")).alias("n"))
    moved = nearest.where("n.target is not null").select("k", moved_below(F.col("k"), F.col("n.above"), F.col("n.target")).alias("_to"))
    keyed = usage.withColumn("k", project_key(F.col("repo_root"))).join(moved, "k", "left")
    return keyed.withColumn("repo_root", F.coalesce("_to", "repo_root")).select(*usage.columns)


def local_repositories(usage: DataFrame, remotes: DataFrame) -> DataFrame:
    """usage of other machines moved to the local clone of the same remote; two clones of one remote match nothing.

    remotes has (machine, root, url); a null machine is this one.
    """
    named = remotes.withColumn("remote", git_remote(F.col("url"))).where("remote is not null")
    here = named.where("machine is null").groupBy("remote").agg(F.min("root").alias("to"), F.count("*").alias("n")).where("n = 1").select("remote", "to")
    there = named.where("machine is not null").join(here, "remote").select(F.col("machine").alias("_m"), comparable_key(F.col("root")).alias("_at"), "to")
    keys = usage.where("machine is not null").select(F.col("machine").alias("_m"), project_key(F.col("repo_root")).alias("_k")).where("_k is not null").distinct()
    walk = keys.select("_m", "_k", F.posexplode(ancestors(F.col("_k"))).alias("depth", "_above")).withColumn("_at", comparable_key(F.col("_above")))
    moved = walk.join(there, ["_m", "_at"]).groupBy("_m", "_k").agg(F.min_by(moved_below(F.col("_k"), F.col("_above"), F.col("to")), "depth").alias("_to"))
    keyed = usage.withColumn("_k", project_key(F.col("repo_root")))
    out = keyed.join(moved, (keyed.machine == moved._m) & (keyed._k == moved._k), "left").drop(moved._k)
    return out.withColumn("repo_root", F.coalesce("_to", "repo_root")).select(*usage.columns)


def _matched(far: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """far with its flags _with and _blank set for rows that a row of near with equal keys answers.

    Both have `_id`, blank where a row names no request. By machine, each row of near answers
    once: first a row with its own id, then one without for one with, one with for one without,
    and last two without. Counts decide how many of a machine's rows are answered, so near is
    only summed and never meets far row by row.
    """
    named = F.col("_id") != ""
    own = near.where(named).groupBy(*keys, "_id").agg(F.count("*").alias("_a"))
    all_ = near.groupBy(*keys).agg(F.count_if(named).alias("_w"), F.count_if(~named).alias("_b"))
    rows = far.join(all_, keys, "left").join(own, [*keys, "_id"], "left").fillna(0, ["_w", "_b", "_a"])
    group = Window.partitionBy("machine", *keys)
    order = [F.col("session_id"), F.col("event_index")]
    open_ = ~F.col("_with") & ~F.col("_blank")

    def answer(rows: DataFrame, test, free, by: list[str], flag: str) -> DataFrame:
        rows = rows.withColumn("_t", open_ & test).withColumn("_n", F.row_number().over(Window.partitionBy("machine", *keys, *by, "_t").orderBy(*order)))
        return rows.withColumn(flag, F.col(flag) | (F.col("_t") & (F.col("_n") <= free)))

    used = lambda flag: F.sum(F.col(flag).cast("int")).over(group)
    rows = answer(rows, named, F.col("_a"), ["_id"], "_with")
    rows = answer(rows.withColumn("_u", used("_with")), ~named, F.col("_w") - F.col("_u"), [], "_with")
    rows = answer(rows.withColumn("_u", used("_blank")), named, F.col("_b") - F.col("_u"), [], "_blank")
    rows = answer(rows.withColumn("_u", used("_blank")), ~named, F.col("_b") - F.col("_u"), [], "_blank")
    return rows.drop("_w", "_b", "_a", "_t", "_n", "_u")


def _first_of_machines(far: DataFrame, keys: list[str]) -> DataFrame:
    """Machines in turn are a running count: the n-th equal row of any machine is the n-th of the first that has n."""
    nth = F.row_number().over(Window.partitionBy("machine", *keys).orderBy("event_index"))
    first = F.row_number().over(Window.partitionBy(*keys, "_n").orderBy("machine", "event_index"))
    return far.withColumn("_n", nth).withColumn("_f", first).where("_f = 1").drop("_f", "_n")


def _without_copies(near: DataFrame, far: DataFrame, exact: list[str], loose: list[list[str]], skewed: list[str]) -> DataFrame:
    """Rows of far without those that near has; of skewed machines by the loose keys in turn instead of the exact ones."""
    far = _first_of_machines(far, [*exact, "_id"]).withColumns({"_with": F.lit(False), "_blank": F.lit(False), "_old": F.coalesce(F.col("machine").isin(skewed), F.lit(False))})
    left = _matched(far.where(~F.col("_old")), near, exact)
    if skewed:
        old = far.where("_old")
        for keys in loose:
            old = _matched(old, near, keys)
        left = left.unionByName(old)
    return left.where("not _with and not _blank")


def merge_machines(local: DataFrame, remote: DataFrame, skewed: list[str] | None = None) -> DataFrame:
    """local, and the rows of remote that it doesn't have: a multiset difference, machine by machine.

    Rows are the same if their content is, and the ids of their requests where both name any. Of
    two machines with the same row the first by name keeps it. Rows of machines in `skewed`,
    whose parser was another version, are the same as rows of this machine's session at the same
    time with the same model, then at the same time.
    """
    columns = [c for c in local.columns if c != "machine"]

    def keyed(df: DataFrame) -> DataFrame:
        ids = F.concat_ws("\x1f", F.coalesce("message_id", F.lit("")), F.coalesce("request_id", F.lit("")))
        return df.withColumns({"_h": content_hash(df), "_id": F.when(F.col("message_id").isNull() & F.col("request_id").isNull(), F.lit("")).otherwise(ids), "_model": F.coalesce("model", F.lit(""))})

    turn = ["source", "session_id", "ts"]
    left = _without_copies(keyed(local), keyed(remote), ["_h"], [[*turn, "_model"], turn], skewed or [])
    return local.unionByName(left.select(*columns, "machine").select(*local.columns))


def merge_session_events(local: DataFrame, remote: DataFrame, skewed: list[str] | None = None) -> DataFrame:
    """local session events, and those of remote(source, session_id, kind, ts, event_index, machine, body) that it doesn't have.

    Events are the same if source, session, kind, time and body (JSON text) are; those of skewed
    machines if all but the body is. Each local row answers one of a machine.
    """
    keyed = lambda df: df.withColumns({"_id": F.lit(""), "_b0": F.coalesce("body", F.lit(""))})
    turn = ["source", "session_id", "ts", "kind"]
    left = _without_copies(keyed(local), keyed(remote), [*turn, "_b0"], [turn], skewed or [])
    return local.unionByName(left.select(*local.columns))


def worktree_roots(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recorded roots, repositories by name) of roots(root, repo_key), the git roots that were seen.

    A repository of at least four letters gives its name to folders; of several with one name the
    only one with worktrees does, else none.
    """
    named = roots.select(F.col("repo_key"), (F.col("root") != F.col("repo_key")).alias("tree")).groupBy("repo_key").agg(F.bool_or("tree").alias("tree"))
    named = named.withColumn("name", F.lower(F.element_at(key_segments(F.col("repo_key")), -1))).where("char_length(name) >= 4")
    found = named.groupBy("name").agg(F.count("*").alias("n"), F.count_if("tree").alias("trees"), F.min("repo_key").alias("any"), F.min(F.when(F.col("tree"), F.col("repo_key"))).alias("treed"))
    names = found.select("name", F.when(F.col("n") == 1, F.col("any")).when(F.col("trees") == 1, F.col("treed")).alias("repo_key")).where("repo_key is not null")
    return roots.select(comparable_key(F.col("root")).alias("at"), "root", "repo_key"), names


def move_worktrees(usage: DataFrame, roots: DataFrame) -> DataFrame:
    """usage whose project, a worktree of a repository in roots(root, repo_key), moves to the repository.

    The nearest recorded root decides: a worktree's moves with the path below it, a repository's
    own stays. Without one, a folder named <repository>-x or x-<repository> (or with _) does; the
    longest name wins, then the smaller key.
    """
    recorded, names = worktree_roots(roots)
    keys = usage.select(project_key(F.col("repo_root")).alias("_k")).where("_k is not null").distinct()
    walk = keys.select("_k", F.posexplode(ancestors(F.col("_k"))).alias("depth", "above")).withColumn("at", comparable_key(F.col("above")))
    near = walk.join(recorded, "at").groupBy("_k").agg(F.min_by(F.struct("above", "repo_key", (comparable_key(F.col("repo_key")) == F.col("at")).alias("own")), "depth").alias("r"))
    # what stands before and after each - and _ of a folder's name
    lowered = F.transform(key_segments(F.col("_k")), F.lower)
    cuts = lambda s: F.filter(F.sequence(F.lit(1), F.char_length(s)), lambda i: F.substring(s, i, F.lit(1)).isin("-", "_"))
    sides = F.flatten(F.transform(lowered, lambda s: F.flatten(F.transform(cuts(s), lambda i: F.array(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.char_length(s)))))))
    said = keys.join(near.select("_k"), "_k", "left_anti").select("_k", F.explode(F.array_distinct(sides)).alias("name")).join(names, "name")
    said = said.groupBy("_k").agg(F.min_by("repo_key", F.struct(-F.char_length("name"), F.col("repo_key"))).alias("_to"))
    moved = near.where("not r.own").select("_k", moved_below(F.col("_k"), F.col("r.above"), F.col("r.repo_key")).alias("_to")).unionByName(said)
    keyed = usage.withColumn("_k", project_key(F.col("repo_root"))).join(moved, "_k", "left")
    return keyed.withColumn("repo_root", F.coalesce("_to", "repo_root")).select(*usage.columns)


def attribute_to_repo(usage: DataFrame, roots: DataFrame, target: str) -> DataFrame:
    """usage with `attribution`: matched where the nearest git root of roots(root) at or above its directory is target, excluded where it is another, unattributed where there is none."""
    known = roots.select(comparable_key(F.col("root")).alias("at"), "root").dropDuplicates(["at"])
    keys = usage.select("repo_root").where("repo_root is not null").distinct()
    walk = keys.select("repo_root", F.posexplode(ancestors(without_end_separators(F.col("repo_root")))).alias("depth", "above")).withColumn("at", comparable_key(F.col("above")))
    near = walk.join(known, "at").groupBy("repo_root").agg(F.min_by("root", "depth").alias("_root"))
    here = comparable_key(F.col("_root")) == comparable_key(F.lit(target))
    state = F.when(F.col("_root").isNull(), "unattributed").when(here, "matched").otherwise("excluded")
    return usage.join(near, "repo_root", "left").withColumn("attribution", state).select(*usage.columns, "attribution")


def departed(stored: DataFrame, discovered: DataFrame) -> DataFrame:
    """Stored events of files that are gone, less those that the files still there hold: counted as multisets."""
    gone = stored.join(discovered.select("source", "file").distinct(), ["source", "file"], "left_anti")
    live = stored.join(discovered.select("source", "file").distinct(), ["source", "file"], "left_semi")
    h = content_hash(stored)
    have = live.withColumn("_h", h).groupBy("source", "_h", "file").count().groupBy("source", "_h").agg(F.max("count").alias("_have"))
    nth = F.row_number().over(Window.partitionBy("source", "_h", "file").orderBy("event_index"))
    served = gone.withColumn("_h", h).withColumn("_nth", nth)
    served = served.join(have, ["source", "_h"], "left").where("_nth > coalesce(_have, 0)")
    once = F.row_number().over(Window.partitionBy("source", "_h", "_nth").orderBy("file"))
    return served.withColumn("_once", once).where("_once = 1").select(*stored.columns)


def event_to_block(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """events with the block (source, block_start_ms) they fall into: an interval join on the hour and the four before."""
    ms = epoch_ms(F.col("ts"))
    hours = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_MS // HOUR_MS - 1)), lambda i: (F.floor(ms / HOUR_MS) - i) * HOUR_MS)
    candidates = events.withColumn("_h", F.explode(hours)).withColumn("_h", F.col("_h").cast("bigint"))
    hit = candidates.join(blocks.select("source", F.col("block_start_ms").alias("_h")).distinct(), ["source", "_h"])
    return hit.groupBy(*events.columns).agg(F.max("_h").alias("block_start_ms"))


def commit_days(commits: DataFrame, usage_days: DataFrame) -> DataFrame:
    """Commits on days with usage."""
    return commits.join(usage_days.select("day").distinct(), "day", "left_semi")


def pair_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls(file, call_id, ...) with the first result of each id in its file; unanswered calls are unknown."""
    first = F.row_number().over(Window.partitionBy("file", "call_id").orderBy("line"))
    answers = results.withColumn("_n", first).where("_n = 1").select("file", "call_id", F.col("ts").alias("completed_at"), "is_error")
    opened = calls.withColumn("_n", first).where("_n = 1 or call_id is null").drop("_n")
    out = opened.join(answers, ["file", "call_id"], "left")
    status = F.when(F.col("completed_at").isNull() & F.col("is_error").isNull(), "unknown").when(F.col("is_error"), "error").otherwise("ok")
    took = epoch_ms(F.col("completed_at")) - epoch_ms(F.col("ts"))
    return out.withColumns({"status": status, "duration_ms": F.when(took >= 0, took)}).drop("is_error")


def parents(keys: DataFrame) -> DataFrame:
    return keys.withColumn("parent", parent_key(F.col("key")))
