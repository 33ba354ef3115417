"""Column contracts, value domains and fixed lists."""

from __future__ import annotations

# Tiers of a place, widest first.
COUNTRY, ADMIN1, ADMIN2, CITY, PREFIX = range(5)

# Result classes of a lookup.
RESULTS = (
    "STRONG_MATCH", "MULTIPLE_MATCHES", "NO_MATCH", "NOT_SUPPORTED", "NO_COUNTRY",
    "PARTIAL_MATCH", "DELETE", "WORD_MATCH", "WILDCARD_MATCH", "SOUNDEX_MATCH",
)

# Readable names of the event tags that carry a place.
EVENT_NAMES = {
    "DEAT": "Death", "CHR": "Christening", "BURI": "Burial", "BIRT": "Birth",
    "CENS": "Census", "MARR": "Marriage", "RESI": "Residence", "IMMI": "Immigration", "EMMI": "Emmigration",
    "OCCU": "Occupation",
}

# Feature codes loaded when the caller's list has fewer than three entries.
DEFAULT_FEATURES = (
    "ADM1", "ADM2", "ADM3", "ADM4", "ADMF", "AREA", "CH", "CSTL", "CMTY", "EST", "HSP", "FT", "HSTS", "ISL",
    "MSQE", "MSTY", "MT", "MUS", "PAL", "PPL", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLC", "PPLG", "PPLH", "PPLL",
    "PPLQ", "PPLX", "PRK", "PRN", "PRSH", "RUIN", "RGN", "RLG", "STG", "SQR", "SYG", "VAL", "MNMT",
)
MIN_FEATURES = 3

# Default language of alternate names.
DEFAULT_LANGUAGES = ("en",)

# Names kept out of the spelling vocabulary.
NOISE_NAMES = ("died", "buried", "executed", "fatally", "wounded")
NOISE_PHRASE = "gothland cemetery"
NOISE_WORD = "gothland"

# A row that stands for "nothing found" in a candidate listing.
NO_MATCH_SCORE = 9999.0

LOOKUP_SCHEMA = "key STRING, val STRING"

# The part of a gazetteer row that travels with a candidate.
CANDIDATE_FIELDS = (
    "geoid", "name", "lat", "lon", "feature", "tier", "country_iso", "country_name",
    "admin1_id", "admin1_name", "admin2_id", "admin2_name", "first_year",
)

