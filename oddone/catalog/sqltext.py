"""SQL (DuckDB) spellings of the Python string semantics used by the oracles."""

# Fixed value: Python's str.isspace() characters as an RE2 class.
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def strip_think(g: str) -> str:
    return f"CASE WHEN strpos({g}, '<think>') > 0 THEN {strip(f'substr({g}, strpos({g}, {chr(39)}<think>{chr(39)}) + 7)')} ELSE {g} END"


def strip_echo(p: str, g: str) -> str:
    w = f"list_filter(list_reverse({split(p)}), lambda x: contains({g}, x))[1]"
    after = f"right({g}, strpos(reverse({g}), reverse({w})) - 1)"
    return f"CASE WHEN {w} IS NULL THEN {strip(g)} ELSE {strip(after)} END"


def strip_label(g: str) -> str:
    after = f"CASE WHEN strpos({g}, 'Falcon:') > 0 THEN right({g}, strpos(reverse({g}), reverse('Falcon:')) - 1) ELSE {g} END"
    return strip(after)


def match_first(g: str, y: str, z: str) -> str:
    py, pz = f"strpos(lower({g}), lower({y}))", f"strpos(lower({g}), lower({z}))"
    return f"CASE WHEN {py} > 0 AND ({pz} = 0 OR {py} <= {pz}) THEN {y} WHEN {pz} > 0 THEN {z} END"
