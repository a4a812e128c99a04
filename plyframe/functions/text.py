"""Round metadata, result codes, PGN tags and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of results, and their codes (null: unknown).
RESULTS = {"1": 0, "1-0": 0, "0": 1, "0-1": 1, "5": -1, "0.5-0.5": -1, "1/2-1/2": -1, "draw": -1}
UNKNOWN = ("", "*")


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line: commas in quotes belong to the field, doubled quotes
    are quotes, blanks around a field go."""
    parts = F.split(line, ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    return F.transform(parts, lambda x: F.replace(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))


def too_many(fields: Column, most: int) -> Column:
    return F.size(fields) > most


def result_code(spelling: Column) -> Column:
    """Code of a result: 0, 1, -1 for a draw; null where unknown or misspelt.  Only
    the listed spellings count, in lower case as they are."""
    known = F.create_map(*[F.lit(x) for kv in RESULTS.items() for x in kv])
    return F.try_element_at(known, spelling)


def result_is_valid(spelling: Column) -> Column:
    return spelling.isin(*RESULTS, *UNKNOWN)


def whole_number(typed: Column) -> Column:
    """The whole number that a text is (blanks around it, a sign and single underscores
    between digits are fine), else null; up to 38 digits."""
    plain = F.regexp_replace(F.regexp_replace(typed, r"^\s+|\s+$", ""), "_", "")
    return F.when(typed.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"), plain.try_cast("decimal(38,0)"))


def slug(name: Column) -> Column:
    """Outer white space goes, letters and digits of any script stay, every other
    character becomes an underscore, and outer underscores go."""
    inner = F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(inner, r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def pgn_tag(name: str, value: Column, default: str = "?") -> Column:
    return F.concat(F.lit(f'[{name} "'), F.coalesce(F.nullif(value, F.lit("")), F.lit(default)), F.lit('"]\n'))


def result_tag(code: Column) -> Column:
    return F.when(code == 0, "1-0").when(code == 1, "0-1").when(code == -1, "1/2-1/2").otherwise("*")


def pgn_tags(meta: Column, game: Column) -> Column:
    """The tags of a game and the blank line after them: seven always, a clock where it
    is given.  Quotes in values stay as they are."""
    seven = [pgn_tag(n, v) for n, v in (("Event", meta["event"]), ("Site", meta["site"]), ("Date", meta["date"]), ("Round", meta["round"]), ("White", game["white"]), ("Black", game["black"]), ("Result", result_tag(game["result"])))]
    clocks = [F.when(v != "", pgn_tag(n, v)).otherwise("") for n, v in (("WhiteClock", game["white_clock"]), ("BlackClock", game["black_clock"]))]
    return F.concat(*seven, *clocks, F.lit("\n"))


def label_from_path(path: Column) -> Column:
    """The digit that a photo shows: a parent folder of one digit, else the stem's one
    digit before the first `_`, `-` or blank (or the whole stem); null without."""
    parent = F.regexp_extract(path, r"/([0-9])/[^/]*$", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    own = F.regexp_extract(stem, r"^([0-9])(?:[_\- ]|$)", 1)
    return F.when(parent != "", parent).when(own != "", own)
