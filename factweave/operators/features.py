"""Sparse features of locations as rows (loc, feature), and scores by weights and rules over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators import expressions as E
from factweave.operators import graph

#: The features that have a weight of their own, by the number of the weight.
ATOMIC = (
    "lvars", "gvars", "fields", "allocsites", "single_defs", "ext_allocsites", "assign_const", "prune_by_const", "prune_by_var", "prune_by_not", "pass_to_alloc", "pass_to_alloc_clos",
    "pass_to_realloc", "pass_to_realloc_clos", "return_from_alloc", "return_from_alloc_clos", "return_from_realloc", "return_from_realloc_clos", "inc_itself_by_one", "inc_itself_by_const",
    "inc_itself_by_var", "dec", "dec_itself_by_const", "dec_itself", "mul_itself_by_const", "mul_itself_by_var", "incptr_itself_by_one", "used_as_array_index", "used_as_array_buf",
    "return_from_ext_fun", "mod_in_rec_fun", "mod_inside_loops", "used_inside_loops",
)
_PASS, _RETURN, _INC = ("pass_to_alloc", "pass_to_alloc_clos"), ("return_from_alloc", "return_from_alloc_clos"), ("inc_itself_by_one", "inc_itself_by_const")
#: Rules from weight 34 on. Of each group a location has a feature, and none of the last set.
RULES = (
    ((("lvars",), ("prune_by_const",), _PASS), ()), ((("gvars",), ("prune_by_const",), _PASS), ()), ((("lvars",), _PASS, _INC), ()), ((("gvars",), _PASS, _INC), ()),
    ((("lvars",), _PASS, _RETURN), ()), ((("gvars",), _PASS, _RETURN), ()), ((_PASS, ("used_as_array_buf",)), ()), ((_RETURN, ("used_as_array_buf",)), ()),
    ((("lvars",), _INC, ("mod_inside_loops",)), ()), ((("gvars",), _INC, ("mod_inside_loops",)), ()), ((("lvars",), _INC), ("mod_inside_loops",)), ((("gvars",), _INC), ("mod_inside_loops",)),
)


def commands_features(nodes: DataFrame, commands: DataFrame, recursive: DataFrame) -> DataFrame:
    """(loc, feature), distinct: what single commands say of locations.

    `nodes` are those of nested(), whose `name` is a location; `commands` has tree, proc, kind (set, assume, alloc, call),
    target, callee and in_loop, one row a tree; `recursive` (proc) are the procedures in cycles of calls.
    """
    rows = E.barred(E.with_children(nodes, ["op", "name", "value"]), F.col("op") != "sizeof").where("bar = 0")
    reads = F.col("op").isin("var", "index")
    shape = rows.groupBy("tree").agg((~F.bool_or(F.col("op").isin("var", "mem", "index", "field"))).alias("is_const"))
    # constancy of the second operand alone, for conditions
    first = rows.where("parent is null").select("tree", "op", "name", "first", "second")
    right = rows.where("pos = 1 and depth = 1").select("tree", F.col("pre").alias("top_pre"), F.col("last").alias("top_last"))
    fixed = E.none_below(rows, right, F.col("op").isin("var", "mem", "index", "field")).select("tree", F.lit(True).alias("const_right"))
    roots = first.join(shape, "tree").join(fixed, "tree", "left").join(commands, "tree").join(recursive.select("proc", F.lit(True).alias("rec")), "proc", "left")

    itself = (F.col("first.op") == "var") & (F.col("first.name") == F.col("target"))
    by = lambda op: (F.col("op") == op) & itself
    number, variable = F.col("second.op") == "const", F.col("second.op") == "var"
    one, more = number & (F.col("second.value") == 1), number & (F.col("second.value") > 1)
    is_set, is_test = F.col("kind") == "set", F.col("kind") == "assume"
    tested = is_test & F.col("op").isin("lt", "gt", "le", "ge", "eq", "ne") & F.col("first.op").isin("var", "index")
    of_target = {
        "assign_const": F.col("is_const"), "assign_sizeof": F.col("op") == "sizeof", "inc_itself_by_one": by("plus") & one, "inc_itself_by_const": by("plus") & more, "inc_itself_by_var": by("plus") & variable,
        "incptr_itself_by_one": by("plus_ptr") & one, "incptr_itself_by_const": by("plus_ptr") & more, "mul_itself_by_const": by("times") & more, "mul_itself_by_var": by("times") & variable,
        "dec_itself": by("minus"), "inc": F.col("op") == "plus", "dec": F.col("op") == "minus", "mod_in_rec_fun": F.col("rec"), "mod_inside_loops": F.col("in_loop"),
    }
    made = [_when(is_set & c, F.col("target"), f) for f, c in of_target.items()]
    made += [
        _when(tested & F.col("const_right"), F.col("first.name"), "prune_by_const"), _when(tested & variable, F.col("first.name"), "prune_by_var"),
        _when(is_test & (F.col("op") == "not") & F.col("first.op").isin("var", "index"), F.col("first.name"), "prune_by_not"),
        _when(F.col("kind") == "alloc", F.col("target"), "return_from_alloc"), _when(F.col("callee") == "realloc", F.col("target"), "return_from_realloc"),
    ]
    used = rows.where(reads).select("tree", F.col("name").alias("loc")).distinct().join(commands, "tree")
    passed = [
        _when(F.col("kind") == "alloc", F.col("loc"), "pass_to_alloc"), _when(F.col("callee") == "realloc", F.col("loc"), "pass_to_realloc"),
        _when(F.col("callee").isNotNull() & ~F.col("callee").isin("realloc", "strlen"), F.col("loc"), "return_from_ext_fun"), _when(is_set & F.col("in_loop"), F.col("loc"), "used_inside_loops"),
    ]
    return _rows(roots, made).unionByName(_rows(used, passed)).unionByName(_indexed(rows)).distinct()


def _when(condition: Column, loc: Column, feature: str) -> Column:
    return F.when(condition, F.struct(loc.alias("loc"), F.lit(feature).alias("feature")))


def _rows(of: DataFrame, made: list[Column]) -> DataFrame:
    return of.select(F.explode(F.array_compact(F.array(*made))).alias("f")).select("f.loc", "f.feature").where("loc is not null")


def _indexed(rows: DataFrame) -> DataFrame:
    """What is read to make indexes (the second operand of an address) and addresses (the first, or all of it)."""
    reads = F.col("op").isin("var", "index")
    arrays = rows.where("op = 'index'").select(F.col("name").alias("loc"), F.lit("used_as_array_buf").alias("feature"))
    child = rows.where("parent is not null").select("tree", F.col("parent").alias("at"), "node", "pos", "op", F.col("pre").alias("top_pre"), F.col("last").alias("top_last"))
    asked = rows.where("op in ('index', 'mem', 'field')").select("tree", F.col("node").alias("at"), F.col("op").alias("asks")).join(child, ["tree", "at"])
    pair = F.col("op").isin("plus", "minus", "plus_ptr", "times", "div", "mod", "and", "or", "xor", "lt", "le", "gt", "ge", "eq", "ne", "shift_left", "shift_right", "land", "lor")
    index, address = F.lit("used_as_array_index"), F.lit("used_as_array_buf")
    whole = asked.where((F.col("asks") == "index") | ~pair).select("tree", "top_pre", "top_last", F.when(F.col("asks") == "index", index).otherwise(address).alias("feature"))
    halves = asked.where((F.col("asks") != "index") & pair).select("tree", F.col("node").alias("at"))
    parts = halves.join(child.select("tree", "at", "pos", "top_pre", "top_last"), ["tree", "at"]).select("tree", "top_pre", "top_last", F.when(F.col("pos") == 1, index).otherwise(address).alias("feature"))
    found = E.below(whole.unionByName(parts), rows.where(reads), [F.col("name").alias("loc")])
    return arrays.unionByName(found.select("loc", "feature"))


def copies(nodes: DataFrame, commands: DataFrame) -> DataFrame:
    """(src, dst): variables stored as they are, through casts alone, and where to."""
    seen = E.barred(nodes, F.col("op") == "cast").where("bar = 0 and op = 'var'")
    return seen.select("tree", F.col("name").alias("src")).join(commands.where("kind = 'set'").select("tree", F.col("target").alias("dst")), "tree").select("src", "dst").distinct()


#: Features that spread against and along copies, and the names of what they reach.
BACKWARD = {"pass_to_alloc": "pass_to_alloc_clos", "pass_to_realloc": "pass_to_realloc_clos", "used_as_array_buf": "pass_to_buf"}
FORWARD = {"return_from_alloc": "return_from_alloc_clos", "return_from_realloc": "return_from_realloc_clos"}


def closures(found: DataFrame, copied: DataFrame) -> DataFrame:
    """(loc, feature): the locations that copies lead from to a feature, or from a feature to, without those that have it. All features spread at once, each way in one run."""
    turned = copied.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    made = []
    for edges, names in ((copied, BACKWARD), (turned, FORWARD)):
        marks = found.where(F.col("feature").isin(*names)).select(F.col("loc").alias("node"), "feature")
        far = graph.spread(edges, marks).withColumnRenamed("node", "loc").join(found, ["loc", "feature"], "left_anti")
        to = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        made.append(far.select("loc", to[F.col("feature")].alias("feature")))
    return made[0].unionByName(made[1])


def scores(locations: DataFrame, found: DataFrame, weights: list[float]) -> DataFrame:
    """`locations` (loc) and weight: the sum of the weights of a location's features and of the rules that it meets; 0 without any. Weights that aren't given are 0."""
    spark = found.sparkSession
    weight = lambda n: float(weights[n]) if n < len(weights) else 0.0
    atoms = [(f, weight(n)) for n, f in enumerate(ATOMIC)]
    terms = [(f, n, g, len(groups), False) for n, (groups, _) in enumerate(RULES) for g, names in enumerate(groups) for f in names]
    terms += [(f, n, -1, len(groups), True) for n, (groups, never) in enumerate(RULES) for f in never]
    # both are fixed tables of under a hundred rows
    atom = F.broadcast(spark.createDataFrame(atoms, "feature string, w double"))
    term = F.broadcast(spark.createDataFrame(terms, "feature string, rule int, part int, parts int, never boolean"))
    met = found.join(term, "feature").groupBy("loc", "rule").agg(F.count_distinct(F.when(~F.col("never"), F.col("part"))).alias("n"), F.max("parts").alias("parts"), F.bool_or("never").alias("never"))
    rule = F.element_at(F.array(*[F.lit(weight(len(ATOMIC) + n)) for n in range(len(RULES))]), F.col("rule") + 1)
    gained = found.join(atom, "feature").select("loc", "w").unionByName(met.where("n = parts and not never").select("loc", rule.alias("w")))
    return locations.join(gained.groupBy("loc").agg(F.sum("w").alias("weight")), "loc", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
