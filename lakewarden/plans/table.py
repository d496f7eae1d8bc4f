"""The table that conditions are compiled against, and what a condition compares."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..model import RECORD, Dataset, Dialect, Study


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return "set"
    if isinstance(t, T.NumericType):
        return "num"
    return "bool" if isinstance(t, T.BooleanType) else "text"


def wildcard(d: Dataset) -> str:
    """What ``--`` stands for in the names of a dataset's variables."""
    return d.domain[2:4] if d.domain.startswith("AP") and len(d.domain) >= 4 else d.domain[:2]


#: A key with more rows than this is a hub, so there are as many hubs as that goes into the rows, at most.
HUB_ROWS = 1_000_000


class Table:
    """A DataFrame under construction: helper columns and bindings are added as conditions ask for them."""

    def __init__(self, df: DataFrame, dataset: Dataset | None, study: Study, wildcard: str):
        self.df, self.dataset, self.study, self.wildcard = df, dataset, study, wildcard
        #: The rows as they came, before helper columns and bindings.
        self.rows = df
        self.names = [c for c in df.columns if not c.startswith("__")]
        self._kinds = {f.name: kind_of(f.dataType) for f in df.schema}
        self._made: dict[str, str] = {}
        self.bindings: dict[str, Operand] = {}
        #: Date parts, and texts, by column.
        self.dates: dict = {}
        self.texts: dict[str, Column] = {}
        #: Declared lengths and the like, for rules that ask for numbers as text.
        self.meta = {v.name: v for v in dataset.variables} if dataset else {}

    def resolve(self, name: str) -> str:
        """``--VAR`` with the domain's prefix."""
        return self.wildcard + name[2:] if isinstance(name, str) and name.startswith("--") else name

    def has(self, name: str) -> bool:
        return name in self.names

    def find(self, name: str, dialect: Dialect) -> str | None:
        """The column of that name; 1.0 rules see names in upper case."""
        name = self.resolve(name)
        if name in self.names:
            return name
        if dialect is Dialect.CORE1:
            return next((c for c in self.names if c.upper() == str(name).upper()), None)
        return None

    def kind(self, name: str) -> str:
        return self._kinds[name]

    def col(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def text(self, name: str) -> Column:
        """A column as text; the expression is built once."""
        if name not in self.texts:
            self.texts[name] = tx.text_of(self.col(name), self.kind(name))
        return self.texts[name]

    @property
    def record(self) -> Column:
        return F.col(RECORD)

    def add(self, expr: Column, key: str | None = None) -> Column:
        """A helper column; the same key gives the same column."""
        if key and key in self._made:
            return F.col(self._made[key])
        name = f"__x{len(self._made)}"
        self._made[key or name] = name
        self.df = self.df.withColumn(name, expr)
        return F.col(name)

    def add_all(self, *exprs: Column) -> list[str]:
        """Names of helper columns that do not read each other, added in one step."""
        names = []
        for _ in exprs:
            names.append(f"__x{len(self._made)}")
            self._made[names[-1]] = names[-1]
        self.df = self.df.withColumns(dict(zip(names, exprs)))
        return names

    def settled(self, verdict: Column) -> Column:
        """A verdict that filters are not pushed below.

        Pushed down, a filter repeats every helper column in place, and those
        again repeat theirs; the marker is not deterministic, so filters on it
        stay above the columns that were written out.
        """
        return verdict & (self.add(F.monotonically_increasing_id(), "mark") >= 0)

    def join(self, other: DataFrame, keys: list[tuple[Column, str]], value: str, kind: str, small: bool = True) -> Column:
        """Left join a table of unique keys; NULL keys pair with NULL."""
        name = f"__x{len(self._made)}"
        self._made[name] = name
        renamed = other.select(*(F.col(f"`{k}`").alias(f"{name}_k{i}") for i, (_, k) in enumerate(keys)), F.col(f"`{value}`").alias(name))
        on = F.lit(True)
        for i, (left, _) in enumerate(keys):
            on = on & left.eqNullSafe(F.col(f"{name}_k{i}"))
        self.df = self.df.join(renamed, on, "left").drop(*(f"{name}_k{i}" for i in range(len(keys))))
        self._kinds[name] = kind
        return F.col(name)

    def of_key(self, keys: list[Column], having: Column, **aggregates: Column) -> Column:
        """Whether the aggregates of a row's key meet ``having``; ``__n`` is the number of its rows.

        Keys are summed before they are shuffled, and only those that meet the test are joined
        back: hubs by a broadcast, the others by their key. The rows of hubs, which are
        done by then, take their record as a further key, so they are dealt to all tasks.
        """
        made = repr(([str(k) for k in keys], str(having), sorted((n, str(c)) for n, c in aggregates.items())))
        if made in self._made:
            return F.col(self._made[made])
        name = self._made[made] = f"__x{len(self._made)}"
        self._kinds[name] = "bool"
        found = {"__n": F.count(F.lit(1)), **aggregates}
        named = {f"k{i}": k for i, k in enumerate(keys)}
        try:
            met = self.rows.groupBy(*(k.alias(n) for n, k in named.items())).agg(*(c.alias(n) for n, c in found.items())).filter(having).select("__n", *named)
        except AnalysisException:  # keys of helper columns: aggregated apart, they would repeat all that made them
            w = W.partitionBy(*keys)
            self.df = self.df.withColumns(named | {n: c.over(w) for n, c in found.items()}).withColumn(name, F.coalesce(having, F.lit(False))).drop(*named, *found)
            return F.col(name)

        def renamed(of: DataFrame, mark: str) -> DataFrame:
            # 0, though not as a constant, which would be no key of the join.
            return of.select(*(F.col(f"k{i}").alias(f"{mark}_k{i}") for i in range(len(keys))), F.lit(True).alias(mark), F.least("__n", F.lit(0)).alias(f"{mark}_s"))

        def on(mark: str) -> Column:
            return reduce(Column.__and__, (k.eqNullSafe(F.col(f"{mark}_k{i}")) for i, k in enumerate(keys)))

        hub, rest, spread = f"{name}h", f"{name}r", f"{name}s"
        # At most one hub per HUB_ROWS rows is broadcast.
        self.df = self.df.join(F.broadcast(renamed(met.filter(F.col("__n") > HUB_ROWS), hub)), on(hub), "left")
        self.df = self.df.withColumn(spread, F.when(F.col(hub), F.col(RECORD)).otherwise(F.lit(0).cast("bigint")))
        self.df = self.df.join(renamed(met.filter(F.col("__n") <= HUB_ROWS), rest), on(rest) & (F.col(spread) == F.col(f"{rest}_s")), "left")
        self.df = self.df.withColumn(name, F.coalesce(F.col(hub), F.col(rest), F.lit(False))).drop(hub, rest, spread, f"{hub}_s", f"{rest}_s", *(f"{m}_k{i}" for m in (hub, rest) for i in range(len(keys))))
        return F.col(name)


@dataclass
class Operand:
    """One side of a condition."""

    col: Column
    kind: str = "text"
    #: Its values come from a column of the table, row by row.
    per_row: bool = False
    #: Plan-time values: one for a scalar, several for a set.
    values: list | None = None
    #: One set for the whole dataset rather than one per row.
    collection: bool = False
    #: Rows whose reference names no column.
    no_column: Column | None = None
    column: str | None = None
    #: The members of a dataset-wide set as a table (v), joined rather than collected.
    source: DataFrame | None = None
    #: The text of a column, where it has been built.
    as_text: Column | None = None

    @property
    def is_set(self) -> bool:
        return self.kind == "set"

    def text(self) -> Column:
        return self.as_text if self.as_text is not None else tx.text_of(self.col, self.kind)

    def blank(self) -> Column:
        return tx.blank(self.col, self.kind)

    def number(self) -> Column:
        return tx.number(self.col, self.kind)


def literal(value: object) -> Operand:
    """A rule's own value; a list is a set for the whole dataset."""
    if isinstance(value, list):
        texts = [tidy(v) for v in value]
        return Operand(F.array(*map(F.lit, texts)) if texts else F.array().cast("array<string>"), "set", values=list(value), collection=True)
    if isinstance(value, bool):
        return Operand(F.lit(value), "bool", values=[value])
    if isinstance(value, (int, float)):
        return Operand(F.lit(float(value)), "num", values=[value])
    return Operand(F.lit(str(value)), "text", values=[value])


def tidy(value: object) -> str:
    """A plan-time value as the text that data would hold."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return "" if value is None else str(value)


@dataclass
class Context:
    """What an operator sees of its condition."""

    name: str
    exists: bool
    target: Operand | None
    value: Operand | None
    condition: dict
    table: Table
    dialect: Dialect
    unresolved: list[str] = field(default_factory=list)

    @property
    def core1(self) -> bool:
        return self.dialect is Dialect.CORE1

    def refuse_rows(self, message: str) -> Column:
        """Unknown: refused later if a row hangs on it."""
        self.unresolved.append(message)
        return F.lit(None).cast("boolean")

    def names(self, value: object) -> list[str]:
        """Column names of a condition's field, sets of names in bindings written out."""
        out: list[str] = []
        for v in value if isinstance(value, list) else [value]:
            if isinstance(v, str) and v.startswith("$"):
                bound = self.table.bindings.get(v)
                out += [str(x) for x in (bound.values or [])] if bound else []
            elif isinstance(v, str):
                out.append(self.table.resolve(v))
        return list(dict.fromkeys(out))
