"""Scalar rules on genotype calls, ids and names, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortframe.functions.expr import as_col

# Genotype texts that mean "no call".
VCF_MISSING = ("./.", ".|.", ".")
IUPAC_MISSING = ("N", "-", "?", "")

# Row labels that are marker metadata, not samples.
META_LABELS = ("POS", "REF", "ALT", "CHR", "CHROM")

# Exact aliases of model names.
MODEL_ALIASES = {
    "random_forest": "randomforest", "rf": "randomforest", "randomforest": "randomforest",
    "svm": "svr", "svr": "svr",
    "lgbm": "lightgbm", "lightgbm": "lightgbm",
    "xgb": "xgboost", "xgboost": "xgboost",
}

# Parts of a model name, tested in this order.
MODEL_PARTS = (
    ("randomforest", "randomforest"), ("rf", "randomforest"), ("svr", "svr"),
    ("lightgbm", "lightgbm"), ("lgbm", "lightgbm"), ("xgboost", "xgboost"), ("xgb", "xgboost"),
    ("elasticnet", "elasticnet"), ("lasso", "lasso"), ("ridge", "ridge"),
)

SYNTHETIC_PREFIX = "SYNTHETIC_"


def try_double(text: str | Column) -> Column:
    """Number in the text, null when there is none (blank counts as none)."""
    return F.trim(as_col(text).cast("string")).try_cast("double")


def vcf_dosage(gt: str | Column) -> Column:
    """Number of alleles equal to 1 in a GT text; phase does not matter."""
    text = as_col(gt)
    alleles = F.split(F.replace(text, F.lit("|"), F.lit("/")), "/")
    ones = F.size(F.filter(alleles, lambda a: a == "1"))
    return F.when(text.isNotNull() & ~text.isin(*VCF_MISSING), ones)


def iupac_dosage(gt: str | Column) -> Column:
    """Dosage of a letter call counted against reference letter A."""
    text = F.upper(F.trim(as_col(gt)))
    others = F.length(F.replace(text, F.lit("A"), F.lit("")))
    return (F.when(text.isNull() | text.isin(*IUPAC_MISSING), F.lit(None).cast("int"))
             .when(F.length(text) == 1, others)
             .otherwise(others % 3))


def generic_dosage(value: str | Column) -> Column:
    """Dosage from mixed notations: a number as it is, then ``a/b``, then one base."""
    text = F.upper(F.trim(as_col(value)))
    alleles = F.transform(F.split(text, "/"), lambda a: F.trim(a).try_cast("int"))
    summed = F.when(F.forall(alleles, lambda a: a.isNotNull()),
                    F.aggregate(alleles, F.lit(0), lambda acc, a: acc + a).cast("double"))
    number = F.when(~F.lower(text).isin("nan", "+nan", "-nan"), text.try_cast("double"))
    return (F.when(number.isNotNull(), number)
             .when(F.contains(text, F.lit("/")), summed)
             .when(text.isin("A", "T", "G", "C"), F.lit(0.0)))


def clean_dosage(value: str | Column) -> Column:
    """Any text or number to an integer 0..2, null to 0."""
    return F.least(F.lit(2), F.greatest(
        F.lit(0), F.rint(F.coalesce(try_double(value), F.lit(0.0))).cast("int")))


def is_valid_call(value: str | Column) -> Column:
    """Whether the rounded value is 0, 1 or 2."""
    return F.rint(as_col(value)).isin(0.0, 1.0, 2.0)


def is_meta_label(label: str | Column) -> Column:
    return F.upper(as_col(label)).isin(*META_LABELS)


def has_id_prefix(label: str | Column, prefix: str) -> Column:
    """Whether the id starts with the prefix; a null id does not."""
    return F.coalesce(F.startswith(as_col(label).cast("string"), F.lit(prefix)), F.lit(False))


def model_name_by_alias(name: str | Column, aliases: Mapping[str, str] = MODEL_ALIASES) -> Column:
    low = F.lower(F.coalesce(as_col(name), F.lit("")))
    out = low
    for target in sorted(set(aliases.values())):
        names = [k for k, v in aliases.items() if v == target]
        out = F.when(low.isin(*names), F.lit(target)).otherwise(out)
    return out


def model_name_by_part(name: str | Column) -> Column:
    low = F.lower(F.coalesce(as_col(name), F.lit("")))
    out = None
    for part, target in MODEL_PARTS:
        hit = F.contains(low, F.lit(part))
        out = F.when(hit, target) if out is None else out.when(hit, target)
    return out.otherwise(low)


def context_name(context: str | Column) -> Column:
    """``context_X`` for texts naming context or prompt A..E, baseline for none."""
    text = as_col(context)
    out = F.when(text.isNull() | (text == "baseline"), F.lit("baseline"))
    for letter in "ABCDE":
        out = out.when(text.rlike(f"(context|prompt)_{letter}"), F.lit(f"context_{letter}"))
    return out.otherwise(text)


def k_from_name(name: str | Column) -> Column:
    return F.regexp_extract(as_col(name), r"_k(\d+)", 1).try_cast("int")


def fallback_from_name(name: str | Column) -> Column:
    return F.regexp_extract(as_col(name), r"_f(\d+)_s(\d+)", 1).try_cast("int")


def seed_from_name(name: str | Column) -> Column:
    return F.regexp_extract(as_col(name), r"_f(\d+)_s(\d+)", 2).try_cast("int")


def parse_fraction(text: str | Column) -> Column:
    """``80%`` or ``0.8`` to a number in 0..1; null when it is neither."""
    s = F.trim(as_col(text))
    number = try_double(F.regexp_replace(s, "%$", ""))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0),
                      F.when(s.endswith("%"), number / 100.0).otherwise(number))) \
            * F.when(number.isNotNull(), 1.0)


def synthetic_id(sample_id: str | Column, prefix: str = SYNTHETIC_PREFIX) -> Column:
    text = as_col(sample_id)
    return F.when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))


def numbered_id(prefix: str, number: str | Column, width: int = 6) -> Column:
    text = as_col(number).cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0")))


def delta_marker(new: str | Column, old: str | Column, higher_is_better: bool = True,
                 band: float = 0.01) -> Column:
    """'up' when the change is an improvement beyond the band, 'down' when it is a loss."""
    gain = (as_col(new) - as_col(old)) * (1.0 if higher_is_better else -1.0)
    return (F.when(gain.isNull(), F.lit("N/A")).when(gain > band, F.lit("up"))
             .when(gain < -band, F.lit("down")).otherwise(F.lit("")))


def strip_id_prefix(sample_id: str | Column, marker: str = "SAMEA") -> Column:
    text = as_col(sample_id)
    return F.when(text.startswith(marker), F.regexp_replace(text, "^[^_]*_", "")).otherwise(text)
