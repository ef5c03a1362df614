"""Small tables of the harmony operators."""

from __future__ import annotations

# Fixed values of the domain, in their natural order.
SHARP_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
FLAT_NAMES = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]
NOTE_NAMES = ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]

# Chord suffixes and their intervals, the more specific first.
TEMPLATES = [
    ("maj9", (0, 2, 4, 7, 11)),
    ("m9", (0, 2, 3, 7, 10)),
    ("9", (0, 2, 4, 7, 10)),
    ("7b9", (0, 1, 4, 7, 10)),
    ("7#9", (0, 3, 4, 7, 10)),
    ("maj7", (0, 4, 7, 11)),
    ("mMaj7", (0, 3, 7, 11)),
    ("m7", (0, 3, 7, 10)),
    ("m7b5", (0, 3, 6, 10)),
    ("7", (0, 4, 7, 10)),
    ("7sus4", (0, 5, 7, 10)),
    ("augMaj7", (0, 4, 8, 11)),
    ("dim7", (0, 3, 6, 9)),
    ("6", (0, 4, 7, 9)),
    ("m6", (0, 3, 7, 9)),
    ("add9", (0, 2, 4, 7)),
    ("aug", (0, 4, 8)),
    ("dim", (0, 3, 6)),
    ("sus4", (0, 5, 7)),
    ("sus2", (0, 2, 7)),
    ("", (0, 4, 7)),
    ("m", (0, 3, 7)),
]
# What each interval above a root counts, and the suffixes that read as minor.
INTERVAL_WEIGHTS = [3.0, 0.5, 1.0, 2.5, 2.5, 1.0, 1.5, 1.5, 1.0, 1.5, 2.0, 2.0]
MINORISH = ["m", "m7", "m6", "m9", "mMaj7", "dim", "dim7", "m7b5"]

# Krumhansl-Schmuckler key profiles.
KS_MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
KS_MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]

# Degree names by mode and the label of each chord suffix.
ROMAN_MAJOR = ["I", "♭II", "II", "♭III", "III", "IV", "♭V", "V", "♭VI", "VI", "♭VII", "VII"]
ROMAN_MINOR = ["i", "♭II", "ii", "III", "♯III", "iv", "♯iv", "v", "VI", "♯vi", "VII", "♯vii"]
SUFFIX_LABEL = {
    "": "", "m": "", "maj7": "maj7", "mMaj7": "maj7", "m7": "7", "7": "7", "maj9": "maj9", "m9": "9", "9": "9",
    "7b9": "7♭9", "7#9": "7♯9", "6": "6", "m6": "6", "add9": "add9", "sus2": "sus2", "sus4": "sus4", "7sus4": "7sus4",
    "dim": "°", "dim7": "°7", "m7b5": "ø7", "aug": "+", "augMaj7": "+maj7",
}

# Core qualities of corpus tokens and the suffixes that stand for each.
QUALITIES = ["maj", "min", "7", "maj7", "m7", "sus4", "dim", "m7b5"]
TOKEN_SUFFIX = {
    "": "maj", "maj": "maj", "5": "maj", "6": "maj", "add9": "maj",
    "maj9": "maj7", "maj7": "maj7", "maj11": "maj7", "maj13": "maj7",
    "min": "min", "min6": "min", "minadd9": "min",
    "min7": "m7", "min9": "m7", "min11": "m7", "min13": "m7", "minmaj7": "m7",
    "7": "7", "9": "7", "11": "7", "13": "7", "7sus4": "7",
    "sus2": "sus4", "sus4": "sus4", "sus": "sus4",
    "dim": "dim", "dim7": "dim", "aug": "maj", "min7b5": "m7b5", "m7b5": "m7b5",
    "no3d": "maj", "7no3d": "7", "add13": "maj", "add11": "maj", "Gadd13": "maj", "maj6": "maj", "min6/9": "min", "6/9": "maj",
}
# Pitch classes of the letters.
LETTER_PC = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def templates_sql() -> str:
    """VALUES rows (tmpl, sfx, ivs mask, n) in template order."""
    return ", ".join(f"({i}, '{s}', {sum(1 << v for v in ivs)}, {len(ivs)})" for i, (s, ivs) in enumerate(TEMPLATES))


def values_sql(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
