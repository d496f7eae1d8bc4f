"""The public API."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import catalog, results, runner
from .model import Dataset, Library, Result, Rule, Study
from .plans import scope
from .report import report_text
from .sinks import write_findings
from .sources import frame, study_folder
from .sources.testcase import read_case

__all__ = ["check_dataset", "check_study", "filter_findings", "list_ct_packages", "list_rules", "read_study", "report_text", "summary", "write_findings"]

filter_findings, summary = results.filter_findings, results.summary


def read_study(spark: SparkSession, path: str | Path, library: Library | None = None) -> Study:
    """Load a folder: a test case (_datasets.csv), or dataset files beside define.xml and stf.xml."""
    study = read_case(spark, path) if (Path(path) / "_datasets.csv").exists() else study_folder.read_folder(spark, path, library.entities if library else None)
    if library:
        study.library = library
    return study


def _chosen(rules: list[Rule], standard: str | None, version: str | None, substandard: str | None, include_deprecated: bool) -> list[Rule]:
    found = [r for r in scope.of_family(rules, standard) if (include_deprecated or r.status.lower() != "deprecated") and scope.for_standard(r, standard, version, substandard)]
    if not found:
        raise ValueError("no rule of the catalogue is written for this standard and version")
    return found


def check_study(
    spark: SparkSession, study: Study | str | Path, rules: list[Rule], standard: str | None = None, version: str | None = None, use_case: str | None = None,
    max_records: int | None = 1000, include_deprecated: bool = False, ct_package: str | None = None, substandard: str | None = None, library: Library | None = None,
) -> Result:
    """Run every applicable rule on every dataset of a study."""
    if not isinstance(study, Study):
        study = read_study(spark, study, library)
    if library:
        study.library = library
    study.product, study.version = standard or study.product, version or study.version
    study.use_case, study.substandard = use_case or study.use_case, substandard or study.substandard
    study.ct_package = ct_package or study.ct_package or study_folder.ct_package_of(study)
    return runner.run(spark, _chosen(rules, standard, version, substandard, include_deprecated), study, max_records)


def check_dataset(
    spark: SparkSession, x: DataFrame | str | Path, rules: list[Rule], domain: str | None = None, standard: str | None = None, version: str | None = None,
    max_records: int | None = 1000, include_deprecated: bool = False, library: Library | None = None,
) -> Result:
    """The same for one table or file; rules that read other datasets are left out, with that reason."""
    d = frame.from_frame(x, domain) if isinstance(x, DataFrame) else study_folder.read_file(spark, Path(x), domain)
    study = Study({d.name.upper(): d}, product=standard or "", version=version or "", library=library or Library())
    chosen = _chosen(rules, standard, version, None, include_deprecated)
    lone = [r for r in chosen if not (scope.other_domains(r) - {d.name.upper(), d.domain}) and r.rule_type != "Domain Presence Check"]
    out = runner.run(spark, lone, study, max_records)
    apart = [(r.id, d.name, f"needs {', '.join(sorted(scope.other_domains(r))) or 'a whole study'}, which is not supplied") for r in chosen if r not in lone and scope.applies(r, d, study)]
    if apart:
        out.skipped = out.skipped.union(spark.createDataFrame(apart, "rule_id string, domain string, reason string"))
        out.info["skipped"] += len(apart)
    return out


def list_rules(rules: list[Rule], **wanted: object) -> list[dict]:
    """The rule catalogue as rows."""
    return catalog.list_rules(rules, **wanted)


def list_ct_packages(library: Library, family: str | None = None) -> list[dict]:
    """Terminology releases, newest first."""
    rows = [p for p in library.packages if not family or str(p["package_type"]).upper() == family.upper()]
    return sorted(rows, key=lambda p: (str(p["package_type"]), str(p["package_date"])), reverse=True)


def open_dataset(name: str, df: DataFrame) -> Dataset:
    """A dataset of a DataFrame, for studies put together by hand."""
    return frame.from_frame(df, name)
