"""Column-name grammar, feature families and file-name mappings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Name pattern -> feature family; the first match wins.
FAMILY_PATTERNS = (
    (r"_PT$", "pt"),
    (r"_Eta$", "eta"),
    (r"_Phi$", "phi"),
    (r"_Mass$", "mass"),
    (r"_PID$", "pid"),
    (r"_Charge$", "charge"),
    (r"_JetPuppiAK\d+_BTag$", "puppibtag"),
    (r"_JetPuppiAK\d+_BTagPhys$", "puppibtag"),
    (r"_JetAK\d+_BTag$", "btag"),
    (r"_JetAK\d+_BTagPhys$", "btag"),
    (r"_PuppiW$", "puppiw"),
    (r"_MET$", "met"),
    (r"_MET_Phi$", "phi"),
    (r"_PrimaryVertex_SumPT2$", "vertexpt2"),
    (r"_PrimaryVertex_[XYZT]$", "vertexcoord"),
    (r"_IsolationVar$", "isolation"),
    (r"_IsolationVarRhoCorr$", "isolation"),
    (r"_EhadOverEem$", "EhadOverEem"),
    (r"_D0$", "displacement"),
    (r"_DZ$", "displacement"),
    (r"_NCharged$", "ncharged"),
    (r"_NNeutrals$", "nneutrals"),
)
NO_FAMILY = "other"
# ---------------------------------------------------------------------------


def family_of(name: str) -> str:
    """Family of one declared column name (planning time)."""
    return next((fam for pat, fam in FAMILY_PATTERNS if re.search(pat, name)), NO_FAMILY)


def family(name: Column) -> Column:
    """Family of a column of names (run time)."""
    return F.coalesce(
        *[F.when(name.rlike(pat), F.lit(fam)) for pat, fam in FAMILY_PATTERNS], F.lit(NO_FAMILY)
    )


def parsed_name(name: Column) -> Column:
    """``<view>_<group>_<feature>`` -> struct(view_group, feature); nulls if it does not fit."""
    parts = F.split(name, "_", 3)
    fits = F.size(parts) == 3
    return F.struct(
        F.when(fits, F.concat_ws("_", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).alias(
            "view_group"
        ),
        F.when(fits, F.get(parts, F.lit(2))).alias("feature"),
    )


def plottable(names: list[str], skip: tuple[str, ...] = ("Constituents",)) -> dict[str, list[str]]:
    """view_group -> columns; names off the grammar and skipped features are left out."""
    grouped: dict[str, list[str]] = {}
    for name in names:
        parts = name.split("_", 2)
        if len(parts) == 3 and parts[2] not in skip:
            grouped.setdefault("_".join(parts[:2]), []).append(name)
    return grouped


def plain_path(uri: Column) -> Column:
    """Path of a file URI: a scan's metadata has blanks and other signs encoded."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_name(path: Column) -> Column:
    """Name of the folder that holds the file."""
    return F.element_at(F.split(path, "/"), -2)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def shard_to_source(name: Column) -> Column:
    """``<stem>_x.npy`` -> ``<stem>.parquet``."""
    return F.regexp_replace(name, r"_x\.npy$", ".parquet")


def source_to_shard(name: Column) -> Column:
    """``<stem>.parquet`` -> ``<stem>_x.npy``."""
    return F.regexp_replace(name, r"\.parquet$", "_x.npy")


def label_shard(name: Column) -> Column:
    """``<stem>_x.npy`` -> ``<stem>_y.npy``."""
    return F.regexp_replace(name, r"_x\.npy$", "_y.npy")
