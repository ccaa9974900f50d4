"""Field values from evidence: extraction rules, resolution, validation, critic, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import text as T

#: Confidence of each way to find a value, best first.
CONFIDENCES = {"labelled": 0.9, "list": 0.78, "pattern": 0.74, "line": 0.66}
MISSING, PASSING = "Required field is missing", 0.7


def labelled_value(text: Column, label: Column) -> Column:
    """What follows a label at a line's start, or a sign in a line that holds the label; null without either."""
    name = F.replace(label, F.lit("_"), F.lit(" "))
    quoted = F.regexp_replace(name, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    pattern = F.concat(F.lit(r"(?im)^[^\S\n]*+"), quoted, F.lit(r"\s*+(?:[:#=|-]\s*+|(?<=\s\s))([^\n\r]{1,260})"))
    direct = F.when(name != "", F.nullif(F.call_function("regexp_extract", text, pattern, F.lit(1)), F.lit("")))
    wanted = T.normalise(label)
    after = lambda line: T.strip(F.regexp_replace(line, r"^[^:#=|-]*[:#=|-]", ""))
    fit = F.filter(
        F.split(text, r"\r?\n"), lambda x: F.contains(T.normalise(x), wanted) & x.rlike(r"[:#=|-]") & (after(x) != "")
    )
    loose = F.when(wanted != "", F.get(F.transform(fit, after), F.lit(0)))
    return T.trim_value(F.coalesce(direct, loose))


def best_line(text: Column, tokens: Column) -> Column:
    """The first line that shares most tokens, else the first usable line, cut to 260 characters."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: T.strip_chars(x, " |")), lambda x: F.length(x) >= 2)
    scored = F.transform(lines, lambda x, i: F.struct(T.overlap(tokens, T.tokens(x)).alias("n"), (-i).alias("i"), x.alias("line")))
    best = F.array_max(F.filter(scored, lambda s: s["n"] > 0))["line"]
    usable = F.filter(F.transform(lines, lambda x: T.strip_chars(x, " |#")), lambda x: (F.length(x) >= 2) & ~x.rlike(r"^!{1,2}\["))
    return F.coalesce(T.trim_value(best), T.preview(F.get(usable, F.lit(0)), 260))


def extract(pairs: DataFrame) -> DataFrame:
    """``pairs(field_path, label, type, evidence_id, text, …)`` with raw_value, value, confidence and method.

    A labelled value is taken before a match of the type's pattern, and for texts a line before nothing.
    """
    text = F.col("text")
    pattern = None
    for kind in C.TYPE_PATTERNS:
        test = F.col("type") == kind
        pattern = F.when(test, C.first_match(text, kind)) if pattern is None else pattern.when(test, C.first_match(text, kind))
    tokens = T.tokens(F.concat_ws(" ", "field_path", "label"))
    rows = pairs.withColumns(
        {
            "_labelled": F.coalesce(labelled_value(text, F.col("label")), labelled_value(text, F.col("field_path"))),
            "_pattern": pattern,
            "_line": F.when(F.col("type") == "text", best_line(text, tokens)),
        }
    )
    method = F.when(F.col("_labelled").isNotNull(), "labelled").when(F.col("_pattern").isNotNull(), "pattern").when(F.col("_line").isNotNull(), "line")
    sure = None
    for name, value in CONFIDENCES.items():
        sure = F.when(F.col("method") == name, value) if sure is None else sure.when(F.col("method") == name, value)
    rows = rows.withColumn("method", method).withColumn("raw_value", F.coalesce("_labelled", "_pattern", "_line"))
    value = T.sanitise(C.coerce(F.col("raw_value"), F.col("type")), F.col("field_path"))
    return rows.withColumns({"value": value, "confidence": F.coalesce(sure, F.lit(0.0))}).drop("_labelled", "_pattern", "_line")


def resolve(candidates: DataFrame, *key: str, keep_conflicts: bool = True) -> DataFrame:
    """(key…, value, status, confidence, n_values): the best candidate of each key.

    ``candidates(key…, value, confidence, method, evidence_ids)``; best is by confidence, then value, evidence and
    method. More than one distinct value is a conflict: it keeps the best value, or with ``keep_conflicts`` off has
    neither value nor confidence. Below 0.7 the status is low_confidence, else validated. Both sides are plain
    aggregates, so a key with very many candidates is summed up before the shuffle.
    """
    best = F.min_by(F.struct("value", "confidence"), F.struct(-F.col("confidence"), "value", "evidence_ids", "method"))
    norm = T.normal_value(F.col("value"))
    grouped = candidates.groupBy(*key).agg(best.alias("b"), F.min(norm).alias("lo"), F.max(norm).alias("hi"), F.count(F.lit(1)).alias("candidates"))
    conflict = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))
    status = F.when(conflict, "conflict").when(F.col("b.confidence") < PASSING, "low_confidence").otherwise("validated")
    drop = conflict & F.lit(not keep_conflicts)
    return grouped.select(
        *key, F.when(~drop, F.col("b.value")).alias("value"), status.alias("status"), F.when(drop, 0.0).otherwise(F.col("b.confidence")).alias("confidence"), "candidates"
    )


def memory_confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(0.98), 0.48 + score / 20.0), 3)


def is_missing(value: Column) -> Column:
    return value.isNull() | (T.strip(value) == "") | value.isin("[]", "{}")


def type_errors(value: Column, kind: Column, required: Column) -> Column:
    """array<string>: what is wrong with a JSON value for its schema type; a number may be written as a boolean."""
    v = F.lower(T.strip(value))
    number = v.try_cast("double").isNotNull() | v.isin("true", "false")
    whole = v.rlike(r"^-?\d+$") | v.isin("true", "false")
    wrong = (
        F.when((kind == "number") & ~number, "Expected number")
        .when((kind == "integer") & ~whole, "Expected integer")
        .when((kind == "boolean") & ~v.isin("true", "false"), "Expected boolean")
        .when((kind == "array") & ~v.startswith("["), "Expected array")
        .when((kind == "object") & ~v.startswith("{"), "Expected object")
    )
    return F.when(value.isNull(), F.when(required, F.array(F.lit(MISSING))).otherwise(F.array().cast("array<string>"))).otherwise(F.array_compact(F.array(wrong)))


def below_threshold(confidence: Column, percent: Column) -> Column:
    """Whether a confidence, as whole percent, is below a threshold."""
    return F.round(confidence * 100) < percent


def is_edited(value: Column, raw_value: Column) -> Column:
    """Whether a value differs from the one that was read, both as JSON."""
    return ~F.to_json(F.struct(value.alias("v"))).eqNullSafe(F.to_json(F.struct(raw_value.alias("v"))))


def parse_payload(text: Column, kind: str) -> Column:
    """A model's answer as a struct or map of type ``kind``: without code fences, objects only; null for anything else."""
    bare = T.strip(F.regexp_replace(T.strip(text), r"^```[a-zA-Z]*\s*|\s*```$", ""))
    return F.when(bare.startswith("{"), F.from_json(bare, kind))


#: The kind of parser that takes each label of a page's regions.
REGION_PARSERS = {"table": "table", "figure": "image", "picture": "image", "image": "image", "chart": "image"}


def region_parser(label: Column) -> Column:
    """table, image or text: which parser a region of a page goes to, by its label."""
    out = None
    for part, parser in REGION_PARSERS.items():
        test = F.contains(F.lower(label), F.lit(part))
        out = F.when(test, parser) if out is None else out.when(test, parser)
    return out.otherwise("text")


def schema_status(value: Column, errors: Column, confidence: Column) -> Column:
    return F.when(value.isNull(), "missing").when(F.size(errors) > 0, "invalid").when(confidence >= PASSING, "validated").otherwise("low_confidence")


def quality_errors(value: Column, field_path: Column) -> Column:
    """array<string>: markup, agency or cover noise left in a value."""
    return F.array_compact(
        F.array(
            F.when(value.rlike(r"<[a-zA-Z/][^>]*>"), "contains_markup"),
            F.when(value.rlike(r"!\[|\]\("), "contains_markdown_link"),
            F.when(T.is_cover_noise(value), "cover_noise"),
            F.when(F.lower(field_path).rlike("title") & value.rlike(T.RATING_AGENCY), "rating_agency_as_title"),
        )
    )


def critic(fields: DataFrame) -> DataFrame:
    """(job_id, missing, accounting_mismatch, issues): required fields without value; assets that are not liabilities + equity.

    ``fields(job_id, field_path, value, required)``. The tolerance is 2% of the assets, at least 1.
    """
    amount = lambda name: F.max(F.when(F.lower("field_path").isin(name, f"total_{name}"), C.number_like(F.col("value"))))
    rows = fields.groupBy("job_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("required") & is_missing(F.col("value")), F.col("field_path")))).alias("missing"),
        *[amount(n).alias(n) for n in ("assets", "liabilities", "equity")],
    )
    gap = F.abs(F.col("assets") - F.col("liabilities") - F.col("equity")) > F.greatest(F.lit(1.0), F.abs("assets") * 0.02)
    gap = F.coalesce(gap, F.lit(False))
    issues = F.array_compact(
        F.array(
            F.when(F.size("missing") > 0, F.concat(F.lit("missing_required:"), F.array_join("missing", ","))),
            F.when(gap, "accounting_mismatch:assets_vs_liabilities_plus_equity"),
        )
    )
    return rows.select("job_id", "missing", gap.alias("accounting_mismatch"), issues.alias("issues"))


def consistency_score(nulls: Column, conflicts: Column, issues: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1.0 - (nulls + conflicts + issues) * 0.15), 3)


def first_validated_attempt(attempts: DataFrame) -> DataFrame:
    """Of each field's attempts the first validated one, else the last with a value."""
    good = F.col("status") == "validated"
    class_ = F.when(good, 0).when(F.col("value").isNotNull(), 1).otherwise(2)
    order = F.struct(class_, F.when(class_ == 1, -F.col("attempt")).otherwise(F.col("attempt")))
    pick = F.min_by(F.struct("value", "status", "confidence", "attempt"), order)
    return attempts.groupBy("job_id", "field_path").agg(pick.alias("p"), F.count(F.lit(1)).alias("attempt_count")).select("job_id", "field_path", "p.*", "attempt_count")


def final_json(fields: DataFrame, *accepted: str) -> DataFrame:
    """(job_id, final_json): the accepted fields' values as one JSON object each."""
    rows = fields.where(F.col("status").isin(*(accepted or ("validated", "low_confidence", "human_corrected"))))
    return rows.groupBy("job_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_path", "value"))))).alias("final_json"))


def nested_json(fields: DataFrame, depth: int = 4) -> DataFrame:
    """(job_id, final_json): ``fields(job_id, field_path, value)`` as nested objects, dotted paths told apart at their dots.

    Built from the deepest level up, one aggregate a level; a path that is an object has no value of its own. Paths
    deeper than ``depth`` keep the rest as one key.
    """
    parts = F.split("field_path", r"\.", depth)
    bare = lambda x: F.substring(F.to_json(F.struct(x.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(x.alias("v")))) - 6)
    value = F.when(F.col("value").isNull(), "null").otherwise(bare(F.col("value")))
    level = fields.select("job_id", parts.alias("p"), value.alias("json"))
    for at in range(depth, 0, -1):
        deep, rest = level.where(F.size("p") == at), level.where(F.size("p") < at)
        entry = F.concat(bare(F.element_at("p", -1)), F.lit(":"), "json")
        up = deep.groupBy("job_id", F.slice("p", F.lit(1), F.lit(at - 1)).alias("p")).agg(F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}")).alias("json"))
        level = rest.unionByName(up)
    return level.select("job_id", F.col("json").alias("final_json"))


def apply_review(fields: DataFrame, actions: DataFrame) -> DataFrame:
    """``fields`` after each one's last review action: approve validates it, correct sets its value with confidence 1."""
    last = actions.groupBy("job_id", "field_path").agg(F.max_by(F.struct("action", "corrected_value"), F.struct("created_at", "review_id")).alias("r"))
    rows = fields.join(last, ["job_id", "field_path"], "left")
    correct, approve = F.col("r.action") == "correct", F.col("r.action") == "approve"
    return rows.withColumns(
        {
            "value": F.when(correct, F.col("r.corrected_value")).otherwise(F.col("value")),
            "status": F.when(correct, "human_corrected").when(approve, "validated").otherwise(F.col("status")),
            "confidence": F.when(correct, 1.0).otherwise(F.col("confidence")),
        }
    ).drop("r")


def job_status(fields: DataFrame) -> DataFrame:
    """(job_id, status, pending): needs_review while a field is conflicting, missing or invalid."""
    pending = F.col("status").isin("conflict", "missing", "invalid")
    return fields.groupBy("job_id").agg(F.when(F.bool_or(pending), "needs_review").otherwise("completed").alias("status"), F.count_if(pending).alias("pending"))


def object_confidence(children: DataFrame) -> DataFrame:
    """(job_id, parent, confidence): the mean of the children's, 0 if a required one is missing."""
    lost = F.bool_or(F.col("required") & is_missing(F.col("value")))
    return children.groupBy("job_id", "parent").agg(F.when(lost, 0.0).otherwise(F.round(F.avg("confidence"), 3)).alias("confidence"))


def merge_errors(fields: DataFrame, errors: DataFrame) -> DataFrame:
    """Fields with the first error of their root key; ``errors(loc, message, pos)``."""
    first = errors.groupBy(F.get(F.split("loc", r"\."), F.lit(0)).alias("_root")).agg(F.min_by("message", "pos").alias("error"))
    return fields.join(first, fields["field_path"] == first["_root"], "left").drop("_root")


def attach_evidence(fields: DataFrame, evidence: DataFrame, most: int = 5) -> DataFrame:
    """``fields(job_id, field_path, evidence_ids)`` with their first ``most`` distinct evidence items, in order."""
    ids = fields.select("job_id", "field_path", F.posexplode(F.array_distinct("evidence_ids")).alias("pos", "evidence_id"))
    found = ids.join(evidence.select("evidence_id", "text"), "evidence_id")
    order = W.partitionBy("job_id", "field_path").orderBy("pos")
    kept = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    packed = kept.groupBy("job_id", "field_path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence_id", T.preview(F.col("text"), 260).alias("preview")))), lambda x: F.struct(x["evidence_id"].alias("evidence_id"), x["preview"].alias("preview"))).alias("evidence")
    )
    return fields.join(packed, ["job_id", "field_path"], "left")


def missed_fields_report(fields: DataFrame) -> DataFrame:
    """(job_id, report): a markdown table row for each field without value or with a status that needs a look."""
    row = F.concat_ws(
        " | ", F.col("label"), F.concat(F.lit("`"), "field_path", F.lit("`")), F.col("type"), F.when(F.col("required"), "Yes").otherwise("No"), F.initcap("status"),
        F.when(is_missing(F.col("value")), "Value missing").otherwise("Check value"),
    )
    rows = fields.where(is_missing(F.col("value")) | (F.col("status") != "validated")).withColumn("_row", F.concat(F.lit("| "), row, F.lit(" |")))
    return rows.groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_list("_row")), "\n").alias("report"))
