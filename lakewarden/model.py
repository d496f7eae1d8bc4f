"""What the engine works on: studies, datasets, rules, and why a rule was left out."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RECORD = "__record"


class Dialect(Enum):
    """The engine a rule was written for; fixed when the rule is planned."""

    CDISC = "cdisc"
    CORE1 = "core1"

    @property
    def wildcard(self) -> str:
        return "%" if self is Dialect.CORE1 else "&"


class RuleSkipped(Exception):
    """The rule cannot be decided here; the message says why."""


class MissingColumn(RuleSkipped):
    def __init__(self, column: str):
        super().__init__(f"needs {column}, which this dataset does not have")
        self.column = column


@dataclass(frozen=True)
class VariableMeta:
    name: str
    label: str = ""
    type: str = "Char"
    length: int | None = None


@dataclass
class Dataset:
    """A table with one ``__record`` column (1-based) beside its variables."""

    name: str
    df: DataFrame
    variables: list[VariableMeta] = field(default_factory=list)
    label: str = ""
    file_size: int | None = None
    file_name: str = ""
    #: First non-blank values of DOMAIN and RDOMAIN, read once at load.
    domain_value: str = ""
    rdomain_value: str = ""
    #: The rows as they are read, numbered but with their own types; filters on them reach the scan.
    raw: DataFrame | None = None
    #: What one pass over the data has told (first values, emptiness), shared by all rules.
    facts: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.variables:
            kinds = {f.name: "Num" if isinstance(f.dataType, T.NumericType) else "Char" for f in self.df.schema}
            self.variables = [VariableMeta(n, "", k) for n, k in kinds.items() if not n.startswith("__")]

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    @property
    def domain(self) -> str:
        """The DOMAIN value where it looks like a code, else SUPP + RDOMAIN, else the file's name."""
        if self.domain_value and len(self.domain_value) <= 8 and self.domain_value.isalnum():
            return self.domain_value.upper()
        if self.rdomain_value and self.name.upper().startswith(("SUPP", "SQ")):
            return ("SUPP" if self.name.upper().startswith("SUPP") else "SQ") + self.rdomain_value.upper()
        return self.name.upper()


@dataclass
class Library:
    """Reference tables as plain rows; each is small and read once."""

    variables: list[dict] = field(default_factory=list)  # standard, version, domain, variable, label, role, type, core, ordinal, ccode
    model_variables: list[dict] = field(default_factory=list)  # class, variable, label, role, type, ordinal
    domain_classes: dict[str, str] = field(default_factory=dict)
    dataset_labels: list[dict] = field(default_factory=list)  # standard, version, domain, label
    codelists: list[dict] = field(default_factory=list)  # package, codelist_code, codelist, extensible, terms: [(code, value, preferred, synonyms)]
    packages: list[dict] = field(default_factory=list)  # package_type, package_date
    countries: list[dict] = field(default_factory=list)
    entities: dict[str, str] = field(default_factory=dict)  # of a document: key or instanceType to entity
    releases: DataFrame | None = None  # dictionary, version, since (yyyy-mm-dd): releases of external dictionaries, any number


@dataclass
class Study:
    datasets: dict[str, Dataset] = field(default_factory=dict)
    define: dict | None = None
    stf: list[dict] | None = None
    ct_package: str | None = None
    product: str = ""
    version: str = ""
    substandard: str = ""
    use_case: str = ""
    document: str | None = None
    library: Library = field(default_factory=Library)

    def get(self, name: str) -> Dataset | None:
        return self.datasets.get(name.upper())

    def of_domain(self, domain: str) -> list[Dataset]:
        """The files of a domain; a split domain has several."""
        exact = self.get(domain)
        found = [d for d in self.datasets.values() if d.domain == domain.upper()]
        return found or ([exact] if exact else [])


@dataclass(frozen=True)
class Operation:
    id: str
    operator: str
    options: dict

    def get(self, key: str, default: object = None) -> object:
        return self.options.get(key, default)


@dataclass
class Rule:
    id: str
    #: A tree of conditions; for JSONata rules the expression.
    check: dict | str
    rule_type: str = "Record Data"
    sensitivity: str = "Record"
    operations: list[Operation] = field(default_factory=list)
    match_datasets: list[dict] = field(default_factory=list)
    output: list[str] = field(default_factory=list)
    message: str = ""
    description: str = ""
    classes: dict = field(default_factory=dict)
    domains: dict = field(default_factory=dict)
    entities: dict = field(default_factory=dict)
    use_cases: list[str] = field(default_factory=list)
    standards: list[tuple[str, str, str]] = field(default_factory=list)  # (name, version, substandard)
    authorities: list[str] = field(default_factory=list)
    grouping: list[str] = field(default_factory=list)
    executability: str = ""
    status: str = "Published"
    source: str = ""

    @property
    def dialect(self) -> Dialect:
        return Dialect.CORE1 if self.source == "core_contributor" else Dialect.CDISC


@dataclass
class Result:
    """Findings and what was left out, as DataFrames."""

    findings: DataFrame
    skipped: DataFrame
    truncated: DataFrame
    info: dict

    def release(self) -> None:
        """Give back the storage of the passes, once the findings have been read."""
        for kept in self.info.get("kept", []):
            kept.unpersist()
