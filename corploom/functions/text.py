"""Column functions on text, URLs and identities."""

from __future__ import annotations

import hashlib
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corploom.functions.arrays import let

#: White space as the Unicode sense has it, besides ASCII: no-break space, BOM and the space separators.
WHITE = r"[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def trim_white(text: Column) -> Column:
    """Strips every kind of white space, not only blanks."""
    return F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")


def trim_blanks(text: Column) -> Column:
    """Strips blanks and tabs only."""
    return F.regexp_replace(text, r"^[ \t]+|[ \t]+\z", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed_id(kind: str, locator: Column, key: bytes, prefix: str = "src_") -> Column:
    """prefix + the first 32 hex digits of HMAC-SHA256(key, kind NUL locator); the pads are literals."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = key.ljust(64, b"\0")
    pads = [F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C)]
    message = F.concat(F.lit(kind.encode() + b"\0"), locator.cast("binary"))
    inner = F.unhex(F.sha2(F.concat(pads[0], message), 256))
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(pads[1], inner), 256), 1, 32))


URL = r"^([A-Za-z]+)://(\[[0-9A-Fa-f:.]+\]|[^/?#:@\[\]\\\s]+)(?::([0-9]*))?([/\\][^?#]*)?(\?[^#]*)?(?:#.*)?$"


def _encoded(part: Column, also: str) -> Column:
    """Signs beyond printing ASCII, and those of ``also``, as %XX of their UTF-8 bytes."""
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    signs = F.transform(F.split(part, ""), lambda c: F.when(F.rlike(c, F.lit(r"^[\x21-\x7e]$")) & ~F.contains(F.lit(also), c), c).when(c == "", c).otherwise(code(c)))
    return F.when(F.rlike(part, F.lit("[^\\x21-\\x7e]|[" + "".join("\\" + x for x in also) + "]")), F.array_join(signs, "")).otherwise(part)


def _without_dots(path: Column) -> Column:
    """A path without '.' and '..' segments, %2e counting as a dot."""
    parts = F.transform(F.split(F.substr(path, F.lit(2)), "/", -1), lambda x: F.struct(x.alias("x"), F.regexp_replace(x, "(?i)%2e", ".").alias("plain")))

    def step(kept: Column, p: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(p["plain"] == "..", up).when(p["plain"] == ".", kept).otherwise(F.concat(kept, F.array(p["x"])))

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    ends = F.element_at(parts, -1)["plain"].isin(".", "..")
    clean = F.concat(F.lit("/"), F.array_join(folded, "/"), F.when(ends & (F.size(folded) > 0), "/").otherwise(""))
    return F.when(F.rlike(path, F.lit(r"(?i)/(\.|%2e){1,2}(/|\z)")), clean).otherwise(path)


#: Dots of a host name: full stop, ideographic, full-width and half-width.
DOTS = "[.\u3002\uff0e\uff61]"


def punycode(label: Column) -> Column:
    """The Punycode (RFC 3492) of a text, by column functions over its code points.

    The code points beyond ASCII are taken by value, then place. Each is coded as
    the steps that a decoder counts from the one before: over the values, each
    with as many places as there are signs so far, to the place among the signs
    that are no larger. Digits are to a base of 36 with thresholds that follow
    the size of the steps.
    """

    def encoded(points: Column, signs: Column) -> Column:
        beyond = F.array_sort(F.filter(F.transform(points, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: x["c"] >= 128))
        plain = F.array_join(F.filter(signs, lambda x: x < "\u0080"), "")
        n_plain = F.length(plain)
        whole = lambda x, by: F.floor(x / by).cast("long")

        def digits(delta: Column, bias: Column) -> Column:
            start = F.struct(delta.cast("long").alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))

            def digit(s: Column, k: Column) -> Column:
                t = F.least(F.greatest(k * 36 - bias, F.lit(1)), F.lit(26)).cast("long")
                last = s["q"] < t
                d = F.when(last, s["q"]).otherwise(t + (s["q"] - t) % (36 - t))
                sign = F.char(F.when(d < 26, d + 97).otherwise(d + 22))
                return F.when(s["done"], s).otherwise(F.struct(whole(s["q"] - t, 36 - t).alias("q"), F.concat(s["out"], sign).alias("out"), last.alias("done")))

            return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, digit)["out"]

        def adapted(delta: Column, size: Column, first: Column) -> Column:
            begun = F.when(first, whole(delta, 700)).otherwise(whole(delta, 2))
            start = F.struct((begun + whole(begun, size)).alias("d"), F.lit(0).cast("long").alias("k"))
            end = lambda s: s["k"] + whole(36 * s["d"], s["d"] + 38)
            step = lambda s, _: F.when(s["d"] > 455, F.struct(whole(s["d"], 35).alias("d"), (s["k"] + 36).alias("k"))).otherwise(s)
            return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step, end)

        start = F.struct(F.lit(128).cast("long").alias("n"), F.lit(0).cast("long").alias("i"), n_plain.cast("long").alias("h"), F.lit(72).cast("long").alias("bias"), F.lit("").alias("out"))

        def coded(s: Column, x: Column) -> Column:
            place = F.size(F.filter(F.slice(points, F.lit(1), x["i"]), lambda c: c <= x["c"])).cast("long")
            delta = (x["c"] - s["n"]) * (s["h"] + 1) + place - s["i"]
            bias = adapted(delta, s["h"] + 1, s["h"] == n_plain)
            return F.struct(x["c"].cast("long").alias("n"), (place + 1).alias("i"), (s["h"] + 1).alias("h"), bias.alias("bias"), F.concat(s["out"], digits(delta, s["bias"])).alias("out"))

        return F.concat(plain, F.when(n_plain > 0, "-").otherwise(""), F.aggregate(beyond, start, coded)["out"])

    signs = F.regexp_extract_all(label, F.lit("(?s)."), 0)
    return let(signs, lambda s: let(F.transform(s, lambda x: F.ascii(x)), lambda p: encoded(p, s)))


def ascii_host(host: Column) -> Column:
    """A host name in lower case, labels beyond ASCII as ``xn--`` and their Punycode; composed letters are expected (NFC)."""
    labels = F.split(F.lower(host), DOTS, -1)
    shown = F.transform(labels, lambda x: F.when(F.rlike(x, F.lit("^[\\x00-\\x7f]*$")), x).otherwise(F.concat(F.lit("xn--"), punycode(x))))
    return F.when(F.rlike(host, F.lit("^[\\x00-\\x7f]*$")), F.lower(host)).otherwise(F.array_join(shown, "."))


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, '/' for no path, dot segments resolved; null unless plain http(s).

    Backslashes in the path count as slashes; what may not stand in a path or
    query as it is comes as %XX; the query is kept. Hosts in brackets are IPv6
    addresses. A host beyond ASCII is shown in its ASCII form.
    """
    plain = F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
    part = lambda i: F.regexp_extract(plain, URL, i)
    scheme, host, port = F.lower(part(1)), ascii_host(part(2)), F.regexp_replace(part(3), "^0+(?=[0-9])", "")
    default = F.when(scheme == "http", "80").otherwise("443")
    shown = F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port))
    path = F.when(part(4) == "", "/").otherwise(_without_dots(_encoded(F.translate(part(4), "\\", "/"), "\"<>`{}^")))
    query = F.when(part(5).isin("", "?"), part(5)).otherwise(_encoded(part(5), "\"<>'"))
    fine = scheme.isin("http", "https") & F.rlike(host, F.lit(r"^[\x21-\x7e]+$")) & (F.length(port) < 6)
    return F.when(fine, F.concat(scheme, F.lit("://"), host, shown, path, query))


def url_allowed(url: Column, scheme: str, host: str) -> Column:
    """Whether the canonical URL has exactly this scheme and host."""
    rest = F.lit(f"{scheme}://{host}/")
    return F.coalesce(F.startswith(canonical_url(url), rest), F.lit(False))


def html_escape(text: Column) -> Column:
    """The text with & < > " and ' as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def slug(name: Column, keep: str = "a-z0-9", most: int = 40) -> Column:
    """Lower case; runs of anything else one '-'; cut to ``most`` code points; no '-' at the ends."""
    plain = F.regexp_replace(F.lower(name), f"[^{keep}]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(plain, r"^-+|-+$", ""), 1, most), "-+$", "")


def smart_slice(text: Column, n: int, marks: str = ".!?;") -> Column:
    """At most n code points, cut behind the last sentence mark of the second half, if it has one."""
    cut = F.substring(text, 1, n)
    at = F.greatest(*(F.length(cut) - F.instr(F.reverse(cut), m) + F.when(F.instr(cut, m) > 0, 1).otherwise(-10 * n) for m in marks))
    return F.when(F.length(text) <= n, text).when(at > n // 2, F.substring(text, F.lit(1), at)).otherwise(cut)


def first_match(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """The group of the first pattern that matches; null if none does."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, g), F.lit("")) for p, g in patterns))


def norm_name(name: Column) -> Column:
    """Names compare in lower case without blanks, '-' and '_'."""
    return F.regexp_replace(F.lower(name), r"[ _-]+", "")


def normalize_text(text: Column) -> Column:
    """Full-width ASCII folded, lower case, punctuation to blanks, blanks squeezed."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    plain = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
    return F.trim(F.regexp_replace(F.lower(F.translate(text, wide, plain)), r"[^\p{L}\p{N}]+", " "))


#: Bytes of texts that a task normalises at a time.
SLICE_BYTES = 4 << 20


def nfkc_array(texts: pa.Array, most: int = SLICE_BYTES) -> pa.Array:
    """NFKC of texts, slice by slice: only one slice is held as Python strings (a longer text is a slice of its own)."""
    parts, start = [], 0
    while start < len(texts):
        rows = len(texts) - start
        while rows > 1 and texts.slice(start, rows).nbytes > most:
            rows = (rows + 1) // 2
        parts.append(pa.array((None if t is None else normalize("NFKC", t) for t in texts.slice(start, rows).to_pylist()), pa.string()))
        start += rows
    return pa.concat_arrays(parts) if parts else texts


def nfkc(text: Column) -> Column:
    """Unicode NFKC, which has no built-in function: an Arrow UDF."""
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return nfkc_array(texts)

    return run(text)
