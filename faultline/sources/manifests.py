"""Manifest lines to records with paths, and the facts of a manifest, as expressions: an indentation stack is folded over the lines of a block.

A block is one resource of one release, or one values file; its size is bounded by what
a cluster stores of a resource, so its lines are one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, computed
from ..session import cut

_LEVEL = "struct<d:int,seg:string,item:boolean,text:boolean,open:boolean>"
_RECORD = "struct<line_no:int,sign:string,path:string,value:string>"
#: A fold copies its state at each step, so lines are folded in runs of RUN, and runs into the whole.
RUN = 128
_STATE = f"struct<stack:array<{_LEVEL}>,out:array<{_RECORD}>>"
KEY = r"^([^\s:#][^:]*):(?:\s+(.*))?$"
SCALAR = r"^[|>][-+]?\d*$"
#: Blank lines and comments.
BLANK = r"^[+ -]?\s*(#.*)?$"


def line_parts(line: Column) -> Column:
    """Struct of a marked line: sign (-, + or blank), d (its indentation), item (whether it begins a list item), key, value and text."""
    sign = F.when(F.substring(line, 1, 1).isin("+", "-"), F.substring(line, 1, 1)).otherwise(" ")
    body = F.when(F.substring(line, 1, 1).isin("+", "-", " "), F.substring(line, F.lit(2), F.length(line))).otherwise(line)
    plain = lambda c: F.regexp_replace(c, "^[\"']+|[\"']+$", "")

    def parts(body: Column, text: Column, rest: Column) -> Column:
        keyed = rest.rlike(KEY)
        of = lambda i: F.trim(F.regexp_extract(rest, KEY, i))
        return F.struct(sign.alias("sign"), (F.length(body) - F.length(F.ltrim(body))).cast("int").alias("d"), text.rlike(r"^-( |$)").alias("item"), F.when(keyed, of(1)).alias("key"), F.when(keyed, plain(of(2))).alias("value"), plain(rest).alias("text"), text.alias("whole"))

    return bound(body, lambda b: bound(F.rtrim(F.ltrim(b)), lambda t: bound(F.regexp_replace(t, r"^(- |-$)+", ""), lambda rest: parts(b, t, rest))))


def path_of(stack: Column) -> Column:
    """a.b[c].d of the segments of a stack."""
    parts = F.transform(stack, lambda x: F.when(x["seg"].startswith("["), x["seg"]).otherwise(F.concat(F.lit("."), x["seg"])))
    return F.regexp_replace(F.array_join(parts, ""), r"^\.", "")


def _step(state: Column, line: Column) -> Column:
    """The state after a line: what it is deeper than stays on the stack; a list item may stand at the indentation of its key; lines under a text are of the text."""
    top = F.try_element_at(state["stack"], F.lit(-1))
    in_text = F.coalesce(top["text"] & (line["d"] > top["d"]), F.lit(False))
    above = F.filter(state["stack"], lambda x: in_text | (x["d"] < line["d"]) | (line["item"] & (x["d"] == line["d"]) & x["open"] & ~x["item"]))
    level = lambda d, seg, item, text, open_: F.struct(d.alias("d"), seg.alias("seg"), item.alias("item"), text.alias("text"), open_.alias("open")).cast(_LEVEL)
    yes, no, none = F.lit(True), F.lit(False), F.array().cast(f"array<{_LEVEL}>")
    name = F.when(line["key"] == "name", F.concat(F.lit("["), line["value"], F.lit("]"))).otherwise("[]")

    def with_item(base: Column) -> Column:
        """The new stack and the line's record, of the stack with the line's own list item."""
        key = ~in_text & line["key"].isNotNull()
        text = key & line["value"].rlike(SCALAR)
        opens = key & (line["value"] == "")
        inner = line["d"] + F.when(line["item"], 2).otherwise(0)
        stack = F.concat(base, F.when(text | opens, F.array(level(inner, line["key"], no, text, opens))).otherwise(none))
        full = F.when(key, F.concat(base, F.array(level(inner, line["key"], no, no, no)))).otherwise(base)
        said = F.when(in_text, line["whole"]).when(key & ~opens & ~text, line["value"]).when(~key & (line["text"] != ""), line["text"])
        record = F.struct(line["line_no"].alias("line_no"), line["sign"].alias("sign"), path_of(full).alias("path"), said.alias("value")).cast(_RECORD)
        return F.struct(stack.alias("stack"), F.when(said.isNotNull(), record).alias("record"))

    new = bound(F.concat(above, F.when(line["item"] & ~in_text, F.array(level(line["d"], name, yes, no, no))).otherwise(none)), with_item)
    return bound(new, lambda x: F.struct(x["stack"].alias("stack"), F.concat(state["out"], F.array_compact(F.array(x["record"]))).alias("out")))


def records(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, line_no, sign, path, value): every value of the blocks' lines (by, line_no, line) with the path of keys that leads to it.

    Lines of a text ("key: |") have the path of their key. Blank lines and comments have none.
    """
    rows = lines.filter(~F.col("line").rlike(BLANK)).withColumn("p", line_parts(F.col("line")))
    whole = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("line_no").cast("int").alias("line_no"), "p.*"))).alias("lines"))
    return whole.select(*by, F.explode(_folded(F.col("lines"))).alias("r")).select(*by, "r.*")


def block_records(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, records): the same of blocks that have their lines (line_no, line) in an array, in order; blocks without a record are left out. Nothing is moved or sorted."""
    told = F.filter("lines", lambda x: ~x["line"].rlike(BLANK))
    line = lambda x: bound(line_parts(x["line"]), lambda p: F.struct(x["line_no"].cast("int").alias("line_no"), *[p[c].alias(c) for c in ("sign", "d", "item", "key", "value", "text", "whole")]))
    parsed = blocks.select(*by, computed(F.transform(told, line), lambda x: F.size(x) > 0).alias("lines"))
    return parsed.select(*by, computed(_folded(F.col("lines")), lambda x: F.size(x) > 0).alias("records"))


def _folded(lines: Column) -> Column:
    """The records of an array of parsed lines."""
    nothing = F.array().cast(f"array<{_RECORD}>")
    start = F.struct(F.array().cast(f"array<{_LEVEL}>").alias("stack"), nothing.alias("out")).cast(_STATE)
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / RUN).cast("int")), lambda i: F.slice(lines, i * RUN + 1, RUN))

    def fold_run(state: Column, run: Column) -> Column:
        new = F.aggregate(run, F.struct(state["stack"].alias("stack"), nothing.alias("out")).cast(_STATE), _step)
        return bound(new, lambda x: F.struct(x["stack"].alias("stack"), F.concat(state["out"], x["out"]).alias("out")))

    return F.aggregate(runs, start, fold_run, lambda s: s["out"])


def facts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, kind, name, hook, instance, chart, app_label, scale_target, containers, images) of records: what the new side says, else the old one."""
    path, value = F.col("path"), F.col("value")
    order = F.struct((F.col("sign") == "-").cast("int"), F.col("line_no"))
    first = lambda pattern: F.min_by(value, F.when(path.rlike(pattern), order))
    new = F.col("sign") != "-"
    only = lambda pattern: F.min_by(value, F.when(path.rlike(pattern) & new, F.col("line_no")))
    container = F.regexp_extract(path, r"containers\[([^\]]+)\]", 1)
    return rows.groupBy(*by).agg(
        first(r"^kind$").alias("kind"), first(r"^metadata\.name$").alias("name"), first(r"^metadata\.annotations\.helm\.sh/hook$").alias("hook"), only(r"^metadata\.labels\.(app\.kubernetes\.io/instance|release)$").alias("instance"),
        only(r"^metadata\.labels\.(helm\.sh/)?chart$").alias("chart"), only(r"podSelector\.matchLabels\.(app|app\.kubernetes\.io/name)$").alias("app_label"), only(r"^spec\.scaleTargetRef\.name$").alias("scale_target"),
        F.array_sort(F.collect_set(F.when(new & path.rlike(r"containers\[[^\]]+\]\.name$"), container))).alias("containers"), F.array_sort(F.collect_set(F.when(new & path.rlike(r"\.image$"), value))).alias("images"),
    )


def block_facts(blocks: DataFrame, by: list[str]) -> DataFrame:
    """facts of block_records: each block's facts are found in its own row."""
    order = lambda x: F.struct((x["sign"] == "-").cast("int").alias("old"), x["line_no"].alias("n"), x["value"].alias("value"))
    least = lambda test: F.array_min(F.transform(F.filter("records", test), order))["value"]
    new = lambda x: x["sign"] != "-"
    first = lambda pattern: least(lambda x: x["path"].rlike(pattern))
    only = lambda pattern: least(lambda x: x["path"].rlike(pattern) & new(x))
    each = lambda pattern, value: F.array_sort(F.array_distinct(F.transform(F.filter("records", lambda x: new(x) & x["path"].rlike(pattern)), value)))
    return blocks.select(
        *by, first(r"^kind$").alias("kind"), first(r"^metadata\.name$").alias("name"), first(r"^metadata\.annotations\.helm\.sh/hook$").alias("hook"), only(r"^metadata\.labels\.(app\.kubernetes\.io/instance|release)$").alias("instance"),
        only(r"^metadata\.labels\.(helm\.sh/)?chart$").alias("chart"), only(r"podSelector\.matchLabels\.(app|app\.kubernetes\.io/name)$").alias("app_label"), only(r"^spec\.scaleTargetRef\.name$").alias("scale_target"),
        each(r"containers\[[^\]]+\]\.name$", lambda x: F.regexp_extract(x["path"], r"containers\[([^\]]+)\]", 1)).alias("containers"), each(r"\.image$", lambda x: x["value"]).alias("images"),
    )


#: Kinds that run pods.
WORKLOADS = "Deployment StatefulSet DaemonSet Job CronJob ReplicaSet Rollout Pod".split()


def owners(resources: DataFrame) -> DataFrame:
    """resources (incident_id, block_no, resource, kind, scale_target, app_label) with owner: the workload that a resource is of.

    A workload is its own; an autoscaler's is its target, a policy's the label that it selects; else the workload with
    the longest name that the resource's begins with, else the only one of the incident, else its own name. Names are
    held against prefixes that end before a hyphen, so this is an equi-join.
    """
    resources = cut(resources)  # read three times
    work = resources.filter(F.col("kind").isin(WORKLOADS)).select("incident_id", F.col("resource").alias("workload")).distinct()
    one = work.groupBy("incident_id").agg(F.min("workload").alias("only"), F.max("workload").alias("_most")).filter("only = _most").drop("_most")
    rest = resources.filter(~F.coalesce(F.col("kind").isin(WORKLOADS), F.lit(False))).select("incident_id", "resource").distinct()
    parts = F.split("resource", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "-"))
    begun = rest.select("incident_id", "resource", F.explode(prefixes).alias("workload")).join(work, ["incident_id", "workload"])
    begun = begun.groupBy("incident_id", "resource").agg(F.max_by("workload", F.length("workload")).alias("begun"))
    out = resources.join(begun, ["incident_id", "resource"], "left").join(one, "incident_id", "left")
    own = F.when(F.col("kind").isin(WORKLOADS), F.col("resource"))
    return out.withColumn("owner", F.coalesce(own, "scale_target", "app_label", "begun", "only", "resource")).drop("begun", "only")
