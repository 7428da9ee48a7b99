"""Record schemas, entity types and tag notations."""

from __future__ import annotations

SPAN = "struct<start:int,end:int,label:string>"
NOTE = f"text string, meta struct<note_id:string,patient_id:string>, spans array<{SPAN}>"
TOKEN = "struct<text:string,start:int,end:int,label:string>"
SENTENCE = f"tokens array<string>, labels array<string>, current_sent_info array<{TOKEN}>, note_sent_info struct<start:int,end:int,note_id:string>"
PREDICTION = f"note_id string, tokens array<{TOKEN}>, labels array<string>, predictions array<string>"
SCORES = f"note_id string, tokens array<{TOKEN}>, labels array<string>, predictions array<array<double>>"

NER_TYPES = ["PATIENT", "STAFF", "AGE", "DATE", "PHONE", "ID", "EMAIL", "PATORG", "LOC", "HOSP", "OTHERPHI"]
PRIORITY = {t: 1 if t in ("STAFF", "PATORG", "HOSP", "OTHERPHI") else 2 for t in NER_TYPES}
#: Types that count as protected under the narrower reading.
PHI = {t: "O" if t in ("STAFF", "HOSP", "OTHERPHI") else "PHI" for t in NER_TYPES}
PHI_ALL = {t: "PHI" for t in NER_TYPES}

#: First, inner, last and only token of a span, by notation.
PREFIXES = {"BIO": "BIIB", "BIOES": "BIES", "BILOU": "BILU", "IO": "IIII"}


def prefixes(notation: str) -> str:
    if notation not in PREFIXES:
        raise ValueError(f"notation: one of {', '.join(PREFIXES)}, not {notation!r}")
    return PREFIXES[notation]


def label_vocabulary(notation: str, types: list[str] = NER_TYPES) -> list[str]:
    """All tags of a notation, in code-point order."""
    return sorted({f"{p}-{t}" for p in prefixes(notation) for t in types} | {"O"})


def label_map(notation: str, types: dict[str, str]) -> dict[str, str]:
    """Tags under a projection of types; a type that becomes O loses its prefix."""
    return {"O": "O"} | {f"{p}-{t}": "O" if to == "O" else f"{p}-{to}" for p in prefixes(notation) for t, to in types.items()}


def mapped_types(types: dict[str, str]) -> list[str]:
    """The types that a projection leaves, without O, in order."""
    return sorted(set(types.values()) - {"O"})
