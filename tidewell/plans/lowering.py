"""From a syntax tree to a DataFrame: names are bound, aggregates taken out, the dialect's semantics put into columns.

The same lowering serves batch queries and windowed ones. For a windowed query every stream relation
carries a hidden snapshot number; the query is then answered for all snapshots in one job, as if it
had been run for each of them by itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import scalar, values
from tidewell.functions.values import INT, NULL, REAL, TEXT, Value
from tidewell.plans.dialect import Binary, Call, Expr, Item, Literal, Name, QueryError, Select, Star, Test, Unary

#: The hidden column of a snapshot's number.
SNAPSHOT = "__snapshot"
#: The hidden columns of a stream whose aggregates run on from snapshot to snapshot: a record's window, and the first snapshot that has it.
WIN, MARK = "__win", "__mark"
# Aggregates whose states can be merged
ALGEBRAIC = frozenset("COUNT SUM AVG MIN MAX TOTAL".split())


class NotByRecord(Exception):
    """The joined rows can't be had once for all snapshots, as some of them wait for records or go when one comes."""
# Functions that fold a group
AGGREGATES = frozenset("COUNT SUM AVG MIN MAX TOTAL GROUP_CONCAT STRING_AGG JSON_GROUP_ARRAY JSON_GROUP_OBJECT".split())


@dataclass
class Relation:
    """A table as the lowering sees it. A ``stream`` has a column ``SNAPSHOT``, or the columns ``WIN`` and ``MARK`` if states run on."""

    frame: DataFrame
    stream: bool = False


@dataclass(frozen=True)
class Bound(Expr):
    """A column after binding, by its name inside the plan."""

    inner: str

    def title(self) -> str:
        return self.inner


@dataclass
class Source:
    alias: str
    columns: list[tuple[str, str, T.DataType]] = field(default_factory=list)


def is_aggregate(expr: Expr) -> bool:
    return isinstance(expr, Call) and expr.name in AGGREGATES and not (expr.name in scalar.SCALAR_EXTREMES and len(expr.args) > 1)


def walk(expr: Expr):
    yield expr
    for child in expr.children():
        yield from walk(child)


class Lowering:
    def __init__(self, spark: SparkSession, statement: Select, relations: dict[str, Relation], snapshots: DataFrame | None = None, running: bool = False):
        self.spark, self.statement, self.relations, self.snapshots, self.running = spark, statement, relations, snapshots, running
        self.sources: list[Source] = []
        self.types: dict[str, T.DataType] = {}
        self.replaced: dict[Expr, Value] = {}

    # --- names

    def relation(self, name: str) -> Relation:
        for known, relation in self.relations.items():
            if known.lower() == name.lower():
                return relation
        raise QueryError(f"no such table: {name}")

    def find(self, name: Name) -> Bound | None:
        """The column that a name means; None if there is none."""
        hits = [
            inner
            for source in self.sources
            if name.table is None or source.alias.lower() == name.table.lower()
            for column, inner, _ in source.columns
            if column.lower() == name.column.lower()
        ]
        if len(hits) > 1:
            raise QueryError(f"ambiguous column name: {name.column}")
        return Bound(hits[0]) if hits else None

    def bind(self, expr: Expr, aliases: dict[str, Expr], alias_first: bool = False) -> Expr:
        """Names become columns. An alias stands for its expression, before or after real columns."""
        if isinstance(expr, Name):
            alias = aliases.get(expr.column.lower()) if expr.table is None else None
            if alias is not None and alias_first:
                return alias
            found = self.find(expr)
            if found is not None:
                return found
            if alias is not None:
                return alias
            if self.snapshots is not None:
                return Literal(None, "NULL")  # a stream's column that hasn't been seen yet
            raise QueryError(f"no such column: {expr.title()}")
        if isinstance(expr, Unary):
            return Unary(expr.op, self.bind(expr.operand, aliases, alias_first))
        if isinstance(expr, Binary):
            return Binary(expr.op, self.bind(expr.left, aliases, alias_first), self.bind(expr.right, aliases, alias_first))
        if isinstance(expr, Call):
            if any(isinstance(a, Star) for a in expr.args) and expr.name != "COUNT":
                raise QueryError(f"* can't be an argument of {expr.name}")
            return Call(expr.name, tuple(a if isinstance(a, Star) else self.bind(a, aliases, alias_first) for a in expr.args))
        if isinstance(expr, Test):
            return Test(expr.kind, self.bind(expr.subject, aliases, alias_first), tuple(self.bind(a, aliases, alias_first) for a in expr.args), expr.negated)
        if isinstance(expr, Star):
            raise QueryError("* stands for columns only in SELECT and COUNT")
        return expr

    # --- expressions

    def value(self, expr: Expr) -> Value:
        if expr in self.replaced:
            return self.replaced[expr]
        if isinstance(expr, Bound):
            return values.stored(F.col(expr.inner), self.types[expr.inner])
        if isinstance(expr, Literal):
            return values.literal(expr.value)
        if isinstance(expr, Unary):
            if expr.op == "NOT":
                return Value(~values.truth(self.value(expr.operand)), values.BOOL)
            return values.negative(self.value(expr.operand))
        if isinstance(expr, Binary):
            if expr.op in ("AND", "OR"):
                a, b = values.truth(self.value(expr.left)), values.truth(self.value(expr.right))
                return Value(a & b if expr.op == "AND" else a | b, values.BOOL)
            a, b = self.value(expr.left), self.value(expr.right)
            return values.compare(expr.op, a, b) if expr.op in ("=", "!=", "<", "<=", ">", ">=") else values.arithmetic(expr.op, a, b)
        if isinstance(expr, Test):
            return self.test(expr)
        if isinstance(expr, Call):
            if is_aggregate(expr):
                raise QueryError(f"misuse of aggregate {expr.name}()")
            args = [self.value(a) for a in expr.args]
            if expr.name in scalar.SCALAR_EXTREMES:
                return scalar.SCALAR_EXTREMES[expr.name](args)
            try:
                return scalar.call(expr.name, args)
            except ValueError as error:
                raise QueryError(str(error)) from None
        raise QueryError(f"can't use {expr.title()} here")

    def test(self, expr: Test) -> Value:
        subject, args = self.value(expr.subject), [self.value(a) for a in expr.args]
        if expr.kind == "NULL":
            column = subject.col.isNull()
        elif expr.kind == "LIKE":
            column = values.like(subject, args[0]).col
        elif expr.kind == "BETWEEN":
            column = values.compare(">=", subject, args[0]).col & values.compare("<=", subject, args[1]).col
        else:
            kinds = {subject.kind, *(a.kind for a in args)}
            if len(kinds) == 1 and NULL not in kinds:
                column = subject.col.isin(*[a.col for a in args])
            else:
                column = values.compare("=", subject, args[0]).col
                for a in args[1:]:
                    column = column | values.compare("=", subject, a).col
        return Value(~column if expr.negated else column, values.BOOL)

    def aggregate(self, call: Call) -> tuple[Column, str]:
        name, args = call.name, [self.value(a) for a in call.args if not isinstance(a, Star)]
        if name == "COUNT":
            if len(args) > 1:
                raise QueryError("wrong number of arguments to COUNT()")
            return F.count(args[0].col if args else F.lit(1)), INT
        if not args or len(args) > (2 if name in ("GROUP_CONCAT", "STRING_AGG", "JSON_GROUP_OBJECT") else 1):
            raise QueryError(f"wrong number of arguments to {name}()")
        first = args[0]
        if name == "SUM":
            n = values.number(first)
            return F.sum(n.col), n.kind
        if name == "AVG":
            return F.avg(values.double(first)), REAL
        if name == "TOTAL":
            return F.coalesce(F.sum(values.double(first)), F.lit(0.0)), REAL
        if name in ("MIN", "MAX"):
            return (F.min if name == "MIN" else F.max)(values.output(first)), INT if first.kind == values.BOOL else first.kind
        if name in ("GROUP_CONCAT", "STRING_AGG"):
            # any order will do; sorted, it is the same each time
            if len(args) == 1 or isinstance(args[1].literal, str):
                parts = F.array_sort(F.collect_list(values.text(first)))
                return F.when(F.size(parts) > 0, F.array_join(parts, args[1].literal if len(args) > 1 else ",")), TEXT
            # each row's own separator stands before its text, but for the first
            pair = F.struct(values.text(first).alias("t"), F.coalesce(values.text(args[1]), F.lit("")).alias("s"))
            parts = F.array_sort(F.collect_list(F.when(first.col.isNotNull(), pair)))
            joined = F.array_join(F.transform(parts, lambda p, k: F.when(k == 0, p["t"]).otherwise(F.concat(p["s"], p["t"]))), "")
            return F.when(F.size(parts) > 0, joined), TEXT
        pieces = scalar.json_piece(first)
        if name == "JSON_GROUP_ARRAY":
            return F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(pieces)), ","), F.lit("]")), TEXT
        if len(args) != 2:
            raise QueryError("wrong number of arguments to JSON_GROUP_OBJECT()")
        pair = F.concat(scalar.json_piece(Value(values.text(first), TEXT)), F.lit(":"), scalar.json_piece(args[1]))
        return F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")), TEXT

    # --- relations

    def opened(self, k: int, table) -> tuple[DataFrame, bool]:
        """A table with columns renamed for the plan."""
        relation = self.relation(table.name)
        source = Source(table.alias)
        columns = []
        for j, column in enumerate(relation.frame.schema.fields):
            if column.name in (SNAPSHOT, WIN, MARK):
                continue
            inner = f"_{k}_{j}"
            source.columns.append((column.name, inner, column.dataType))
            self.types[inner] = column.dataType
            columns.append(relation.frame[f"`{column.name.replace('`', '``')}`"].alias(inner))
        self.sources.append(source)
        if relation.stream:
            columns += [F.col(WIN).alias(f"_win{k}"), F.col(MARK).alias(f"_mark{k}")] if self.running else [F.col(SNAPSHOT).alias(f"_k{k}")]
        return relation.frame.select(*columns), relation.stream

    def joined(self) -> DataFrame:
        statement = self.statement
        if statement.table is None:
            return self.spark.range(1).select()
        frame, stream = self.opened(0, statement.table)
        if self.running:
            # a row of streams is there from the last of its records on, unless it is kept by an outer join until one comes
            if not stream or any(j.kind == "right" or j.kind != "inner" and self.relation(j.table.name).stream for j in statement.joins):
                raise NotByRecord
            frame = frame.withColumnsRenamed({"_win0": WIN, "_mark0": MARK})
            for k, join in enumerate(statement.joins, 1):
                right, stream = self.opened(k, join.table)
                on = values.truth(self.value(self.bind(join.on, {})))
                if not stream:
                    frame = frame.join(right, on, join.kind)
                    continue
                frame = frame.join(right, on & (F.col(WIN) == F.col(f"_win{k}"))).withColumn(MARK, F.greatest(MARK, f"_mark{k}"))
            return frame
        if self.snapshots is not None:
            # a static table read first is there in every snapshot; there is one row for each snapshot of the batch
            frame = frame.withColumnRenamed("_k0", SNAPSHOT) if stream else frame.crossJoin(self.snapshots.select(SNAPSHOT))
        for k, join in enumerate(statement.joins, 1):
            right, stream = self.opened(k, join.table)
            if self.snapshots is not None and join.kind == "right" and not stream:
                right, stream = right.crossJoin(self.snapshots.select(F.col(SNAPSHOT).alias(f"_k{k}"))), True
            on = values.truth(self.value(self.bind(join.on, {})))
            if self.snapshots is not None and stream:
                on = on & (F.col(SNAPSHOT) == F.col(f"_k{k}"))
            frame = frame.join(right, on, join.kind)
            if self.snapshots is not None and stream:
                frame = frame.withColumn(SNAPSHOT, F.coalesce(SNAPSHOT, f"_k{k}")).drop(f"_k{k}")
        return frame

    # --- the statement

    def items(self) -> list[Item]:
        """Stars are replaced by the columns they stand for, which are bound already."""
        found = []
        for item in self.statement.items:
            if not isinstance(item.expr, Star):
                found.append(item)
                continue
            star = item.expr.table
            sources = [s for s in self.sources if star is None or s.alias.lower() == star.lower()]
            if not sources:
                raise QueryError(f"no such table: {star}" if star else "no tables specified")
            found += [Item(Bound(inner), name) for s in sources for name, inner, _ in s.columns]
        return found

    def lower(self) -> DataFrame:
        statement = self.statement
        frame = self.joined()
        items = self.items()
        bound = [i.expr if isinstance(i.expr, Bound) else self.bind(i.expr, {}) for i in items]
        labels = [i.label() for i in items]
        aliases = {i.alias.lower(): e for i, e in zip(items, bound, strict=True) if i.alias and not isinstance(i.expr, Bound)}
        if statement.where is not None:
            where = self.bind(statement.where, aliases)
            if any(map(is_aggregate, walk(where))):
                raise QueryError("misuse of aggregate in WHERE")
            frame = frame.where(values.truth(self.value(where)))

        def placed(expr: Expr) -> Expr | None:
            if isinstance(expr, Literal) and isinstance(expr.value, int) and expr.text.isdigit():
                if not 1 <= expr.value <= len(bound):
                    raise QueryError(f"there is no column {expr.value} to group or order by")
                return bound[expr.value - 1]
            return None

        group = [placed(g) or self.bind(g, aliases) for g in statement.group]
        order = [(placed(e) or self.bind(e, aliases, alias_first=True), up) for e, up in statement.order]
        wanted = [*bound, *(e for e, _ in order)]
        calls = list(dict.fromkeys(e for root in wanted for e in walk(root) if is_aggregate(e)))
        if calls or group:
            frame = self.grouped(frame, group, calls, wanted)
        elif self.running:
            frame = self.shown(frame)
        return self.finished(frame, bound, labels, order)

    def grouped(self, frame: DataFrame, group: list[Expr], calls: list[Call], wanted: list[Expr]) -> DataFrame:
        keys = [self.value(g) for g in group]
        folds, kinds = [], []
        for call in calls:
            column, kind = self.aggregate(call)
            folds.append(column)
            kinds.append(kind)
        bare: list[Bound] = []

        def seek(expr: Expr) -> None:
            if expr in group or is_aggregate(expr):
                return
            if isinstance(expr, Bound) and expr not in bare:
                bare.append(expr)
            for child in expr.children():
                seek(child)

        for root in wanted:
            seek(root)
        if self.running and (bare or any(c.name not in ALGEBRAIC for c in calls)):
            frame = self.shown(frame)
        # columns that are neither grouped nor folded come from the row of a lone extreme, else from any row
        extremes = [c for c in calls if c.name in ("MIN", "MAX")]
        lone = extremes[0] if len(extremes) == 1 else None
        for b in bare:
            own = F.col(b.inner)
            if lone is None:
                folds.append(F.first(own))
            else:
                folds.append((F.min_by if lone.name == "MIN" else F.max_by)(own, self.value(lone.args[0]).col))
        hidden = [F.col(SNAPSHOT)] if self.snapshots is not None else []
        by = [*hidden, *(values.output(v).alias(f"_g{k}") for k, v in enumerate(keys))]
        named = [f.alias(f"_a{k}") for k, f in enumerate(folds)] or [F.count(F.lit(1)).alias("_a0")]
        result = self.run_on(frame, keys, calls) if self.running else frame.groupBy(*by).agg(*named)
        if self.snapshots is not None and not group:  # a snapshot without rows has a row of its own
            result = self.snapshots.select(SNAPSHOT).join(result, SNAPSHOT, "left")
        for k, (expr, v) in enumerate(zip(group, keys, strict=True)):
            kind = INT if v.kind == values.BOOL else v.kind
            self.replaced[expr] = Value(F.col(f"_g{k}"), kind, v.affinity, v.any_)
        for k, (call, kind) in enumerate(zip(calls, kinds, strict=True)):
            column = F.col(f"_a{k}")
            if call.name == "COUNT":
                column = F.coalesce(column, F.lit(0).cast("bigint"))
            if call.name == "TOTAL":
                column = F.coalesce(column, F.lit(0.0))
            self.replaced[call] = Value(column, kind)
        for k, b in enumerate(bare):
            self.replaced[b] = values.stored(F.col(f"_a{len(calls) + k}"), self.types[b.inner])
        return result

    def shown(self, frame: DataFrame) -> DataFrame:
        """The joined and filtered rows at every snapshot that has them; from here on each snapshot is by itself."""
        self.running = False
        marks = self.snapshots.select(F.col("win").alias("_w"), F.col("at").alias("_at"), SNAPSHOT)
        return frame.join(marks, (F.col(WIN) == F.col("_w")) & (F.col("_at") >= F.col(MARK)))

    def run_on(self, frame: DataFrame, keys: list[Value], calls: list[Call]) -> DataFrame:
        """The folds of each group at every snapshot from its first one on.

        Records are folded to one state for each window, snapshot and group; states are then merged along the snapshots
        of a window. The work is the records plus the answer, not records times snapshots.
        """
        states, merged = [F.count(F.lit(1)).alias("_n")], []
        over = Window.partitionBy(WIN, *(f"_g{k}" for k in range(len(keys)))).orderBy(MARK).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        for k, call in enumerate(calls):
            args = [self.value(a) for a in call.args if not isinstance(a, Star)]
            column, _ = self.aggregate(call)
            own = F.col(f"_a{k}")
            if call.name == "AVG":
                states += [F.sum(values.double(args[0])).alias(f"_a{k}"), F.count(values.double(args[0])).alias(f"_b{k}")]
                merged.append(F.try_divide(F.sum(own).over(over), F.sum(f"_b{k}").over(over)).alias(f"_a{k}"))
                continue
            states.append((F.sum(values.double(args[0])) if call.name == "TOTAL" else column).alias(f"_a{k}"))
            merge = {"MIN": F.min, "MAX": F.max}.get(call.name, F.sum)
            merged.append(merge(own).over(over).alias(f"_a{k}"))
        groups = [f"_g{k}" for k in range(len(keys))]
        partial = frame.groupBy(WIN, MARK, *(values.output(v).alias(g) for v, g in zip(keys, groups, strict=True))).agg(*states)
        first = partial.groupBy(WIN, *groups).agg(F.min(MARK).alias("_first"))
        marks = self.snapshots.select(F.col("win").alias("_w"), F.col("at").alias(MARK), F.lit(True).alias("_due"))
        due = first.join(marks, (F.col(WIN) == F.col("_w")) & (F.col(MARK) >= F.col("_first"))).drop("_w", "_first")
        rows = due.unionByName(partial.withColumn("_due", F.lit(False)), allowMissingColumns=True)
        # a state and what is due at its snapshot are peers in the order, so either sees both
        ran = rows.select("_due", F.col(MARK).alias(SNAPSHOT), *groups, *(merged or [F.col("_n").alias("_a0")]))
        return ran.where("_due").drop("_due")

    def finished(self, frame: DataFrame, bound: list[Expr], labels: list[str], order: list[tuple[Expr, bool]]) -> DataFrame:
        """Projection, DISTINCT, ORDER BY and LIMIT. Of columns with one name the last one stays."""
        statement, windowed = self.statement, self.snapshots is not None
        last = {label: k for k, label in enumerate(labels)}
        kept = [k for k, label in enumerate(labels) if last[label] == k]
        columns = [values.output(self.value(bound[k])).alias(f"_c{k}") for k in range(len(labels))]
        keys = [values.output(self.value(e)).alias(f"_o{k}") for k, (e, _) in enumerate(order)]
        hidden = [F.col(SNAPSHOT)] if windowed else []
        frame = frame.select(*hidden, *columns, *keys)
        if statement.distinct:
            own = [*([SNAPSHOT] if windowed else []), *(f"_c{k}" for k in range(len(labels)))]
            # a sort key that isn't projected is the least of its distinct row
            folds = [F.min(f"_o{k}").alias(f"_o{k}") for k in range(len(order))]
            frame = frame.groupBy(*own).agg(*folds) if folds else frame.select(*own).distinct()
        sort = [F.col(f"_o{k}").asc_nulls_first() if up else F.col(f"_o{k}").desc_nulls_last() for k, (_, up) in enumerate(order)]
        limit = statement.limit if statement.limit is not None and statement.limit >= 0 else None
        if windowed:
            if limit is not None:
                place = F.row_number().over(Window.partitionBy(SNAPSHOT).orderBy(*(sort or [F.lit(1)])))
                frame = frame.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")
            frame = frame.orderBy(SNAPSHOT, *sort)
        else:
            if sort:
                frame = frame.orderBy(*sort)
            if limit is not None:
                frame = frame.limit(limit)
        return frame.select(*hidden, *(F.col(f"_c{k}").alias(labels[k]) for k in kept))


def lower(spark: SparkSession, statement: Select, relations: dict[str, Relation], snapshots: DataFrame | None = None, running: bool = False) -> DataFrame:
    return Lowering(spark, statement, relations, snapshots, running).lower()
