"""Rule tables: the small literals that operators take as arguments.

The defaults fit the test tables' own vocabulary; users pass their own. Each
table's size is fixed by this file.
"""

from __future__ import annotations

#: (chapter, place, title words that weigh 3, tags that weigh 1)
TAXONOMY: tuple[tuple[str, int, tuple[str, ...], tuple[str, ...]], ...] = (
    ("01", 1, ("therein",), ("the", "and", "that", "with")),
    ("02", 2, ("ungheit",), ("der", "die", "und", "ein")),
    ("03", 3, ("queeau",), ("le", "les", "que", "dans")),
    ("04", 4, ("ciónmente",), ("el", "los", "por", "ción")),
)
#: Patterns of boilerplate lines, plain for every regex dialect: junk signs, cells, shouting.
LINE_PATTERNS: tuple[str, ...] = (r"%%%|\$\$\$|&&&|\*\*\*|###", r" \| ", r"!! [A-Z]+!!")
#: Words that mark what a text is like.
SIGNATURE: tuple[str, ...] = ("the", "and", "that", "with", "this", "from", "der", "die", "das", "und", "ein", "nicht", "que", "les", "dans", "pour", "est", "los", "por", "para", "una", "con", "idiot", "moron")
#: Terms looked for in texts: (term, place).
LEXICON: tuple[tuple[str, int], ...] = (("tion", 1), ("erin", 2), ("heit", 3), ("elle", 4), ("mente", 5), ("thor", 6))
#: Names that mean the same: (variant, name), both normalised.
ALIASES: tuple[tuple[str, str], ...] = (("redwidget", "redgadget"), ("smallring", "tinyring"), ("hotgear", "hotcog"))
#: Parts of names that are noise.
NOISE: tuple[str, ...] = ("bolt", "plate")
#: Patterns counted on web pages: (label, pattern).
HTML_RULES: tuple[tuple[str, str], ...] = (
    ("script", r"<script"),
    ("style", r"<style"),
    ("anchor", r"<a href="),
    ("image", r"<img"),
    ("comment", r"<!--"),
    ("external", r"https?://"),
    ("iframe", r"<iframe"),
)
#: Credentials: (label, pattern).
SECRET_RULES: tuple[tuple[str, str], ...] = (
    ("token", r"token = \"[0-9a-f]{40}\""),
    ("aws", r"AKIA[0-9A-Z]{16}"),
    ("private_key", r"BEGIN [A-Z ]*PRIVATE KEY"),
    ("password", r"password ?[:=] ?\S+"),
    ("bearer", r"Bearer [A-Za-z0-9._-]{20}"),
    ("github", r"gh[pous]_[A-Za-z0-9]{36}"),
)
#: Problem types: (type, place, keyword of a source, head of a chain).
PROBLEM_RULES: tuple[tuple[str, int, str, str], ...] = (
    ("incident", 1, "error", "error"),
    ("growth", 2, "signup", "signup"),
    ("sales", 3, "purchase", "purchase"),
    ("interest", 4, "view", "view"),
)
#: Roles of names: (name, role, stance, challenge).
ROLES: tuple[tuple[str, str, str, str], ...] = (
    ("error", "critic", "against", "What breaks first?"),
    ("purchase", "advocate", "for", "What is it worth?"),
    ("view", "observer", "neutral", "What is not seen?"),
)
#: Full combinations in order of priority, and single anchors.
COMBOS: tuple[tuple[int, tuple[str, ...]], ...] = ((1, ("error", "purchase", "signup")), (2, ("click", "view", "purchase")))
ANCHORS: tuple[str, ...] = ("error", "click", "view")
#: Routes: (route, priority, least score, primary, auxiliaries); their terms with weights; words that exclude; safety words.
ROUTES: tuple[tuple[str, int, float, str, tuple[str, ...]], ...] = (
    ("r1", 10, 2.0, "m1", ("m4", "m5", "m6")),
    ("r2", 20, 2.0, "m2", ("m4",)),
    ("r3", 20, 1.0, "m3", ()),
)
ROUTE_TERMS: tuple[tuple[str, str, float], ...] = (("r1", "the", 1.0), ("r1", "tion", 1.5), ("r2", "und", 1.0), ("r2", "ung", 1.0), ("r3", "que", 1.0))
ROUTE_EXCLUDES: tuple[tuple[str, str], ...] = (("r1", "idiot"), ("r3", "vous"))
SAFETY: tuple[tuple[str, int, str], ...] = (("s1", 1, "worthless"), ("s2", 2, "moron"))


def sql_values(rows) -> str:
    """Rows as the inside of an SQL VALUES list."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        if isinstance(x, (tuple, list)):
            return "[" + ", ".join(map(one, x)) + "]"
        return repr(x)

    return ", ".join("(" + ", ".join(map(one, row)) + ")" for row in rows)
