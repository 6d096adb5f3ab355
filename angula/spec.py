"""What a query is made of: parameters, families, filters and views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

# Form id and label, in series order.
FORMS = {
    "adna": "A-DNA", "bdna": "B-DNA", "zdna": "Z-DNA", "quadruplex": "Quadruplex", "triplex": "Triplex", "double_other": "Other double helix",
    "annotated_other": "Other annotated", "parallel_other": "Parallel", "unannotated": "Unannotated",
}
# Filter names and the entry column or the resolution they stand for.
CLEANLINESS = {"conservative": "passes_conservative", "mw100": "passes_mw100", "relaxed": "passes_relaxed"}
DUPLEX = {"duplex_core": "has_duplex_core", "all_paired": "all_residues_paired"}
RESOLUTION = {"known": None, "le_3_0": 3.0, "le_2_5": 2.5, "le_2_0": 2.0, "le_1_6": 1.6}
# Family levels.
LEVELS = {"backbone": "residue", "sugar": "residue", "pucker": "residue", "base_pair": "pair", "step": "step", "helical": "step"}


@dataclass(frozen=True)
class ParameterSpec:
    param_id: str
    circular: bool = False
    period: float = 360.0
    range_default: tuple[float, float] | None = None
    unit: str = ""


@dataclass(frozen=True)
class FamilySpec:
    """A table of observations. order: columns that order the rows of an entry (the last row of a key wins)."""

    family_id: str
    params: tuple[ParameterSpec, ...]
    level: str = "residue"
    context: str | None = None
    context_options: tuple[str, ...] = ()
    context_empty: str = ""
    secondary: str | None = None
    secondary_options: tuple[str, ...] = ()
    secondary_empty: str = ""
    context_default: tuple[str, ...] = ()
    secondary_default: tuple[str, ...] = ()
    site: str | None = "site_label"
    order: tuple[str, ...] = ("row_index",)


@dataclass(frozen=True)
class EntryFilter:
    """A preset of entry ids stands in for all the other conditions."""

    cleanliness: str = "all"
    duplex: str = "any"
    methods: Sequence[str] | None = None
    resolution: str = "any"
    forms: Sequence[str] | None = None
    preset: Sequence[str] | None = None


@dataclass(frozen=True)
class ObsFilter:
    """None: the family's defaults that are valid, else all options. Unknown ids are left out; a choice that is empty then is an error."""

    terminal: str = "include"
    contexts: Sequence[str] | None = None
    secondary: Sequence[str] | None = None


@dataclass(frozen=True)
class View:
    fine: bool = False
    sigma: float = 1.0
    scale: str = "probability"
    mode: str = "wrap_360"

    def bins(self, circular: bool, joint: bool = False) -> int:
        standard = 72 if circular else (48 if joint else 64)
        return standard * (2 if self.fine else 1)


def chosen(given: Sequence[str] | None, options: Sequence[str], default: Sequence[str] = (), refill: bool = False) -> list[str]:
    """The valid ids of a choice; for None the valid defaults, or all options without any.

    A choice without a valid id is an error, or with refill (what two joined families share) taken as None.
    """
    out = [x for x in given or () if x in options]
    if given is None or (refill and not out):
        out = [x for x in default if x in options] or list(options)
    if not out:
        raise ValueError(f"no valid id among {list(given or [])}")
    return out


def selected_forms(given: Sequence[str] | None) -> list[str]:
    """Known forms of a choice, in series order; an empty choice is all of them."""
    return [f for f in FORMS if not given or f in given] or list(FORMS)
