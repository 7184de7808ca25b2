"""Resolution of model names to keys of the rate table, by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.functions.text import fuzzy_form, provider_of_model

#: Rules in order; the first that finds a key wins.
RULES = ["alias", "direct", "effort_suffix", "provider_prefixed", "release_suffix", "fuzzy"]
# What leaves the priced model the same when it follows a key's name, each part from
# its separator to the next; thinking only does so for one family.
EFFORT = r"-(minimal|low|medium|high|xhigh)$"
PARTS = [r"-\d{4}-\d{2}-\d{2}", r"-\d{4}", r"-\d{8}", r"-latest", r"-(?:minimal|low|medium|high|xhigh)", r"@[a-z0-9.]+", r":\d+", r":latest", r"-v\d+(?=:\d+(?:$|[-@:]))"]
THINKING, THINKERS = "-thinking", "claude"


def release_suffix(rest: Column, key: Column) -> Column:
    """Whether what follows a key in a name is a release of the same model."""
    last = F.element_at(F.split(key, "/"), -1)
    pattern = lambda parts: rf"^(?:(?:{'|'.join(parts)})(?=$|[-@:]))+$"
    return F.when(last.startswith(THINKERS), rest.rlike(pattern([*PARTS, THINKING]))).otherwise(rest.rlike(pattern(PARTS)))


def _last(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def _cuts(c: Column, separators: str) -> Column:
    """Places of separators in a text."""
    return F.filter(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.substring(c, i, F.lit(1)).rlike(f"[{separators}]"))


def resolve_models(models: DataFrame, rates: DataFrame, aliases: DataFrame | None = None, never_fuzzy: tuple[str, ...] = ()) -> DataFrame:
    """(model, model_key, rule) for distinct names in models(model); names without a key have nulls.

    Each name lists the forms under which its rules look for a key, and each key those under which
    it is found, so all rules are one join by equality of rule and form; what equality can't say
    is tested on its few hits, and the best by rule and the rule's own order stays. Names are
    read and made distinct once. The fuzzy rule allows max(2, a fifth of the length) edits between
    forms without punctuation, compares names with the same numbers in order only, and takes the
    first key of the least distance. Aliases name the model to look for in a name's place.
    """
    names = models.select("model").where("model is not null").distinct()
    m, k = F.col("name"), F.col("model_key")
    plain = F.regexp_replace(m, EFFORT, "")
    digits = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), ",")
    form = lambda rule, at, text: F.struct(F.lit(rule).alias("rule"), F.lit(at).alias("at"), text.alias("form"))
    looks = F.concat(
        F.array(form("direct", 0, m), form("direct", 1, _last(m))),
        F.when(m.rlike(EFFORT), F.array(form("effort_suffix", 0, plain), form("effort_suffix", 1, _last(plain)))).otherwise(F.array(form("direct", 0, m))),
        F.array(form("provider_prefixed", 0, m), form("provider_prefixed", 1, _last(m))),
        F.transform(_cuts(m, "-@:"), lambda i: form("release_suffix", 0, F.substring(m, F.lit(1), i - 1))),
        F.transform(_cuts(_last(m), "-@:"), lambda i: form("release_suffix", 1, F.substring(_last(m), F.lit(1), i - 1))),
        F.when(~F.col("model").isin(list(never_fuzzy)), F.array(form("fuzzy", 0, digits(_last(m))))).otherwise(F.array(form("direct", 0, m))),
    )
    said = names.select("model", F.col("model").alias("name"), F.lit(False).alias("aliased"))
    if aliases is not None:
        meant = aliases.select(F.explode(F.array_distinct(F.array(F.lower("alias"), fuzzy_form(F.col("alias"))))).alias("form"), F.col("model_key").alias("name"))
        asked = names.select("model", F.posexplode(F.array(F.col("model"), _last(F.col("model")), fuzzy_form(F.col("model")), fuzzy_form(_last(F.col("model"))))).alias("nth", "form"))
        hit = asked.join(meant, "form").groupBy("model").agg(F.min_by("name", F.struct("nth", "name")).alias("name"))
        said = said.unionByName(hit.select("model", "name", F.lit(True).alias("aliased")))
    asked = said.select("model", "name", "aliased", F.explode(F.array_distinct(looks)).alias("l")).select("model", "name", "aliased", "l.*")
    keys = rates.select("model_key", F.coalesce("provider", provider_of_model(F.col("model_key"))).alias("provider"), F.aggregate(F.array(*[F.col(c).isNotNull().cast("int") for c in ("input", "output", "cache_read", "cache_write")]), F.lit(0), lambda a, b: a + b).alias("n_rates"))
    found = lambda rule, text: F.struct(F.lit(rule).alias("rule"), text.alias("form"))
    after = F.transform(_cuts(k, "/."), lambda i: found("provider_prefixed", F.substring(k, i + 1, F.char_length(k))))
    forms = F.concat(F.array(*[found(r, k) for r in ("direct", "effort_suffix", "release_suffix")], found("fuzzy", digits(k))), after)
    held = keys.select("model_key", "provider", "n_rates", F.explode(forms).alias("f")).select("model_key", "provider", "n_rates", "f.*")
    hits = asked.join(held, ["rule", "form"])
    whole = F.when(F.col("at") == 0, m).otherwise(_last(m))
    a, b = fuzzy_form(_last(m)), fuzzy_form(k)
    edits = F.levenshtein(a, b)
    most = F.greatest(F.lit(2), F.floor(F.char_length(a) / 5)).cast("int")
    test = F.when(F.col("rule") == "release_suffix", release_suffix(F.substring(whole, F.char_length(k) + 1, F.char_length(whole)), k)).when(F.col("rule") == "fuzzy", (a != "") & (b != "") & (edits <= most)).otherwise(True)
    hits = hits.where(test)
    foreign = F.when(F.coalesce(provider_of_model(m) == F.col("provider"), F.lit(False)), 0).otherwise(1)
    mine = lambda rule, *values: [F.when(F.col("rule") == rule, v) for v in values]
    order = [
        F.coalesce(*mine("provider_prefixed", F.col("at")), *mine("direct", F.col("at")), *mine("effort_suffix", F.col("at")), *mine("release_suffix", F.col("at")), edits),
        F.coalesce(*mine("provider_prefixed", foreign), *mine("release_suffix", -F.char_length(k)), F.lit(0)),
        F.coalesce(*mine("provider_prefixed", -F.col("n_rates")), F.lit(0)),
        F.coalesce(*mine("provider_prefixed", F.char_length(k)), F.lit(0)),
    ]
    rank = F.array_position(F.array(*[F.lit(r) for r in RULES]), F.col("rule"))
    first = F.row_number().over(Window.partitionBy("model").orderBy((~F.col("aliased")).cast("int"), rank, *order, k))
    best = hits.withColumn("_first", first).where("_first = 1").select(F.col("model").alias("_model"), "model_key", F.when(F.col("aliased"), "alias").otherwise(F.col("rule")).alias("rule"))
    return names.join(best, names.model == F.col("_model"), "left").select("model", "model_key", "rule")
