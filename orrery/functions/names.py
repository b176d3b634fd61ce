"""Name and identifier normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first_number(s: Column) -> Column:
    """Drops the leading zeros of the first run of digits (after SH2, where that leads); a run of zeros becomes 0."""
    plain = F.regexp_replace(s, r"^([^0-9]*)0+([0-9])", "$1$2")
    sharpless = F.regexp_replace(s, r"^(SH2[^0-9]{0})0+([0-9])", "$1$2")
    return F.when(s.startswith("SH2"), sharpless).otherwise(plain)


def object_key(name: Column) -> Column:
    """Unicode letters and digits, upper case, first number without leading zeros."""
    return _first_number(F.upper(F.regexp_replace(name, r"[^\p{L}\p{N}]", "")))


def merge_key(name: Column) -> Column:
    """As ``object_key``, ASCII only."""
    return _first_number(F.upper(F.regexp_replace(name, r"[^A-Za-z0-9]", "")))


def star_key(name: Column) -> Column:
    """Letters, digits and +, upper case; - only between two digits or between two of A to D."""
    marked = F.regexp_replace(name, r"(?<=[0-9])-(?=[0-9])|(?<=[A-Da-d])-(?=[A-Da-d])", "\u0001")
    return F.replace(F.upper(F.regexp_replace(marked, r"[^\p{L}\p{N}+\u0001]", "")), F.lit("\u0001"), F.lit("-"))


def aliases(text: Column) -> Column:
    """A list split at , ; and |, white space collapsed, blanks dropped."""
    parts = F.transform(F.split(text, r"[,;|]"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(parts, lambda p: p != "")


#: Catalogue prefixes, their namespace numbers and how they are shown.
NAMESPACES = [("HIP", 2, "HIP "), ("HDE", 4, "HDE "), ("HD", 3, "HD "), ("HR", 5, "HR "), ("GAIADR3", 6, "Gaia DR3 "), ("SAO", 7, "SAO "), ("FK5", 8, "FK5 ")]


def parse_identifier(text: Column) -> Column:
    """struct<namespace int, value bigint> of a stellar identifier, null if it is none; Tycho numbers are packed."""
    up = F.upper(F.trim(text))
    tycho = r"^(?:TYCHO-?2|TYC)[ :-]*([0-9]{1,4})[ :-]+([0-9]{1,5})[ :-]+([0-9])$"
    part = lambda k: F.regexp_extract(up, tycho, k).try_cast("bigint")
    packed = F.shiftleft(part(1), 17).bitwiseOR(F.shiftleft(part(2), 3)).bitwiseOR(part(3))
    ok = (part(1) > 0) & (part(2) > 0) & part(3).between(1, 4)
    out = F.when(up.rlike(tycho), F.when(ok, F.struct(F.lit(1).alias("namespace"), packed.alias("value"))))
    compact = F.regexp_replace(up, r"[ :-]", "")
    for prefix, number, _ in NAMESPACES:
        value = F.regexp_extract(compact, f"^{prefix}([0-9]{{1,19}})$", 1).try_cast("bigint")
        valid = (value > 0) & ((value < 2**32) | F.lit(prefix == "GAIADR3"))
        out = out.when(compact.rlike(f"^{prefix}[0-9]{{1,19}}$"), F.when(valid, F.struct(F.lit(number).alias("namespace"), value.alias("value"))))
    return out


def show_identifier(namespace: Column, value: Column) -> Column:
    tycho = F.concat(F.lit("TYC "), F.shiftright(value, 17).cast("string"), F.lit("-"), F.shiftright(value, 3).bitwiseAND(F.lit(0x3FFF)).cast("string"), F.lit("-"), value.bitwiseAND(F.lit(7)).cast("string"))
    out = F.when(namespace == 1, tycho)
    for _, number, shown in NAMESPACES:
        out = out.when(namespace == number, F.concat(F.lit(shown), value.cast("string")))
    return out


def frame_role(text: Column) -> Column:
    """The role that a header's text names; the first of these that it contains wins."""
    t = F.lower(F.regexp_replace(text, r"[^A-Za-z0-9]", ""))
    out = F.when(t.contains("darkflat") | t.contains("flatdark"), "dark-flat")
    for word in ("bias", "dark", "flat", "light"):
        out = out.when(t.contains(word), word)
    return out


def sexagesimal(text: Column) -> Column:
    """Degrees (or hours) of ``[+-]a:b:c`` or ``a b c``; null if malformed."""
    t = F.trim(text)
    parts = F.split(F.regexp_replace(t, r"^[+-]", ""), r"[:\s]+")
    value = parts[0].try_cast("double") + F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(0.0)) / 60.0 + F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(0.0)) / 3600.0
    return F.when(t.rlike(r"^[+-]?\d+([:\s]+\d+){0,1}([:\s]+\d+(\.\d*)?)?$"), value * F.when(t.startswith("-"), -1.0).otherwise(1.0))


def csv_field(text: Column) -> Column:
    """A CSV field, quoted only where it must be."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\\r\\n]'), quoted).otherwise(text)


#: Abbreviations of Greek letters, their names and signs.
GREEK = {
    "Alp": ("Alpha", "α"), "Bet": ("Beta", "β"), "Gam": ("Gamma", "γ"), "Del": ("Delta", "δ"), "Eps": ("Epsilon", "ε"), "Zet": ("Zeta", "ζ"), "Eta": ("Eta", "η"), "The": ("Theta", "θ"),
    "Iot": ("Iota", "ι"), "Kap": ("Kappa", "κ"), "Lam": ("Lambda", "λ"), "Mu": ("Mu", "μ"), "Nu": ("Nu", "ν"), "Xi": ("Xi", "ξ"), "Omi": ("Omicron", "ο"), "Pi": ("Pi", "π"),
    "Rho": ("Rho", "ρ"), "Sig": ("Sigma", "σ"), "Tau": ("Tau", "τ"), "Ups": ("Upsilon", "υ"), "Phi": ("Phi", "φ"), "Chi": ("Chi", "χ"), "Psi": ("Psi", "ψ"), "Ome": ("Omega", "ω"),
}
#: Designation prefixes and the namespaces of their stable ids.
STABLE = [
    ("NGC", "openngc:NGC"), ("IC", "openngc:IC"), ("SH2", "vizier:VII/20:Sh2-"), ("CED", "vizier:VII/231:Ced"), ("LBN", "vizier:VII/9:LBN"), ("UGC", "vizier:VII/26D:UGC"), ("PGC", "vizier:VII/237:PGC"),
    ("HD", "vizier:V/50:HD"), ("WR", "vizier:III/215:WR"), ("M", "messier:M"), ("B", "vizier:VII/220A:B"), ("C", "caldwell:C"),
]


def canonical_alias(alias: Column) -> Column:
    """The usual spelling of Sharpless, Cederblad and LBN designations; others stay."""
    key = F.upper(F.regexp_replace(alias, "[^A-Za-z0-9]", ""))
    out = alias
    for prefix, shown in (("LBN", "LBN "), ("CED", "Ced "), ("SH2", "Sh2-")):
        number = F.regexp_replace(F.substring(key, 4, 99), r"^0+(?=\d)", "")
        out = F.when(key.startswith(prefix), F.concat(F.lit(shown), F.when(number.rlike(r"^\d"), number).otherwise(F.concat(F.lit("0"), number)))).otherwise(out)
    return out


def catalog_aliases(text: Column) -> Column:
    """A list of aliases in their usual spelling, the first of each key."""
    spelled = F.transform(aliases(text), canonical_alias)
    return F.aggregate(spelled, F.array().cast("array<string>"), lambda s, a: F.when(F.exists(s, lambda b: merge_key(b) == merge_key(a)), s).otherwise(F.array_append(s, a)))


def stable_id(alias: Column) -> Column:
    """The stable id that a designation implies, null if none."""
    key = merge_key(alias)
    out = F.lit(None).cast("string")
    for prefix, namespace in reversed(STABLE):
        out = F.when(key.rlike(f"^{prefix}[0-9]"), F.concat(F.lit(namespace), F.substring(key, len(prefix) + 1, 99))).otherwise(out)
    return out


def bright_star_names(text: Column) -> Column:
    """Designations of a catalogue's name field (number in 3 bytes, letter in 3, component, constellation), sorted."""
    flamsteed, greek, part, place = (F.trim(F.substring(text, a, n)) for a, n in ((1, 3), (4, 3), (7, 1), (8, 3)))
    full = F.create_map(*[F.lit(v) for k, (name, _) in GREEK.items() for v in (k, name)])
    sign = F.create_map(*[F.lit(v) for k, (_, s) in GREEK.items() for v in (k, s)])
    spelled = [F.when(flamsteed != "", F.concat(flamsteed, F.lit(" "), place)), *[F.when(greek != "", F.concat(n, part, F.lit(" "), place)) for n in (greek, F.try_element_at(full, greek), F.try_element_at(sign, greek))]]
    return F.when(place != "", F.array_sort(F.array_distinct(F.array_compact(F.array(*spelled))))).otherwise(F.array().cast("array<string>"))


def _mag(text: Column) -> Column:
    m = text.try_cast("double")
    return F.when((m >= -3) & (m < 62), m)


def variable_detail(f: Column) -> Column:
    """A variable star's line of details from its record's fields (an array of at least ten)."""
    low, high = _mag(f[6]), _mag(f[4])
    band = F.when(f[7] == "", f[8]).otherwise(f[7])
    three = lambda c: F.format_string("%.3f", c)
    span = F.when(f[5].contains("("), F.when(low.isNotNull(), F.concat(F.lit("amplitude="), three(low), band))).when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("range="), three(high), F.lit("-"), f[5], three(low), band))
    period = f[9].try_cast("double")
    return F.array_join(F.array_compact(F.array(F.when(f[3] != "", f[3]), span, F.when(period > 0, F.concat(F.lit("period="), F.trim(f[9]), F.lit("d"))))), "; ")


def double_star_detail(components: Column, separation: Column, angle: Column, mag2: Column) -> Column:
    m = _mag(mag2)
    return F.array_join(F.array_compact(F.array(components, F.when(separation.try_cast("double").isNotNull(), F.concat(F.lit("sep="), separation, F.lit("arcsec"))), F.when(angle.try_cast("int").isNotNull(), F.concat(F.lit("pa="), angle, F.lit("deg"))), F.when(m.isNotNull(), F.concat(F.lit("mag2="), F.format_string("%.2f", m))))), "; ")


def hms(ra: Column) -> Column:
    """Right ascension as hours, minutes and seconds."""
    s = F.round(F.pmod(ra, F.lit(360.0)) * 2400.0).cast("long") % 864000
    return F.format_string("%02dh%02dm%04.1fs", F.floor(s / 36000), F.floor(s / 600) % 60, (s % 600) / 10.0)


def dms(dec: Column) -> Column:
    s = F.round(F.abs(dec) * 3600.0).cast("long")
    return F.concat(F.when(dec < 0, "-").otherwise("+"), F.format_string("%02d°%02d'%02d\"", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60))


def checked_json(text: Column, schema: dict[str, str], defaults: dict[str, object]) -> Column:
    """A partial JSON document as a struct with defaults, null if it is no object or names a field that is unknown."""
    kinds = ", ".join(f"{k}: {t}" for k, t in schema.items())
    parsed, keys = F.from_json(text, f"struct<{kinds}>"), F.json_object_keys(text)
    known = F.size(F.array_except(keys, F.array(*map(F.lit, schema)))) == 0
    filled = F.struct(*[F.coalesce(parsed[k], F.lit(defaults.get(k)).cast(t)).alias(k) for k, t in schema.items()])
    return F.when(keys.isNotNull() & known, filled)


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of a configuration: its values in order, each with its length, so that no two lists read alike; nulls differ from blanks."""
    text = [F.when(p.isNull(), F.lit("-")).otherwise(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"))) for p in parts]
    return F.sha2(F.concat_ws("|", *text), 256)
