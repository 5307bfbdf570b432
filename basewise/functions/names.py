"""Chromosome names in several styles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The chromosomes of each species in the plain style, and the prefix of each naming style.
SPECIES = {
    "homo_sapiens": [*map(str, range(1, 23)), "X", "Y", "MT"],
    "mus_musculus": [*map(str, range(1, 20)), "X", "Y", "MT"],
    "rattus_norvegicus": [*map(str, range(1, 21)), "X", "Y", "MT"],
    "danio_rerio": [*map(str, range(1, 26)), "MT"],
    "bos_taurus": [*map(str, range(1, 30)), "X", "Y", "MT"],
    "sus_scrofa": [*map(str, range(1, 19)), "X", "Y", "MT"],
    "drosophila_melanogaster": ["2L", "2R", "3L", "3R", "4", "X", "Y", "MT"],
    "caenorhabditis_elegans": ["I", "II", "III", "IV", "V", "X", "MT"],
    "saccharomyces_cerevisiae": ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "MT"],
}
PREFIX = {"UCSC": "chr", "NCBI": "", "Ensembl": ""}


def _name(chromosome: str, style: str) -> str:
    return "chrM" if style == "UCSC" and chromosome == "MT" else PREFIX[style] + chromosome


def _style(text: str | None) -> str | None:
    return next((s for s in PREFIX if text and s.lower() == text.lower()), None)


def map_name(name: str, style: str | None = "UCSC", species: str = "homo_sapiens", current: str | None = None) -> str | None:
    """``name`` in ``style``. Unknown species or styles leave it; a name that a known style lacks becomes None."""
    to = _style(style)
    if to is None or species.lower() not in SPECIES:
        return name
    own = SPECIES[species.lower()]
    old = _style(current) or next((s for s in ("UCSC", "NCBI") if name in {_name(c, s) for c in own}), None)
    if old is None or PREFIX[old] == PREFIX[to]:
        return name
    return next((_name(c, to) for c in own if _name(c, old) == name), None)


def map_names(column: Column, style: str = "UCSC", current: str = "NCBI", species: str = "homo_sapiens") -> Column:
    """The same for a column, as one literal map."""
    to, old = _style(style), _style(current)
    if to is None or old is None or PREFIX[old] == PREFIX[to] or species.lower() not in SPECIES:
        return column
    return F.create_map(*[F.lit(x) for c in SPECIES[species.lower()] for x in (_name(c, old), _name(c, to))])[column]
