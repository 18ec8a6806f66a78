"""Column functions on identifiers, paths and terms; all but words stay in the JVM."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Keywords and literals that say nothing about a body.
KEYWORDS = tuple(
    """let mut fn pub return if else for while loop match in self this const var def class import from use crate impl struct enum trait async await true false none
    null undefined some ok err as ref where type function new the and or not is of to a an pass super static export default unwrap clone to_string string str i32 i64
    u32 u64 usize f32 f64 bool vec option result with try except catch break continue""".split()
)
# Paths of tests, and of tests, samples, generated and other code that does not ship (lower-cased paths).
TEST_PATH = r"(^|/)(__tests?__|tests?|specs?)(/|$)|\.(test|spec)\.[^/]+$|(^|/)test_[^/]+\.[^/]+$|_test\.[^/]+$|(^|/)[^/]+Tests?\.cs$"
LOW_VALUE_FOLDER = r"(^|/)(__tests?__|tests?|specs?|fixtures?|examples?|samples?|benchmarks?|benches|demos?|mocks?|testdata|integration|evaluate|generated|vendor)(/|$)"
LOW_VALUE_FILE = r"(\.(test|spec)\.[^/]+$)|((^|/)test_[^/]+\.[^/]+$)|(_test\.[^/]+$)|(\.(generated|gen|pb)\.[^/]+$)"


def identifier_components(name: Column, least: int = 2) -> Column:
    """Lower-cased parts of an identifier: camel humps, acronyms, and pieces between marks; shorter parts than least drop out."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.split(F.lower(F.regexp_replace(spaced, r"[^A-Za-z0-9À-ɏ]+", " ")), " ")
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) >= least))


def split_words(texts: pa.Array) -> pa.Array:
    """words of lower-cased texts."""
    parts = pc.split_pattern_regex(texts, "[^a-z0-9à-ÿ]+")
    flat = parts.flatten()
    held = pc.not_equal(flat, "").to_numpy(zero_copy_only=False).astype(bool)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))])
    before = np.concatenate([[0], np.cumsum(held)])
    return pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), flat.filter(pa.array(held)), mask=parts.is_null())


_split_words = F.arrow_udf(ArrayType(StringType()))(split_words)


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits, in order, repeats kept.

    Arrow's linear pattern splits a column of texts at once; Java's takes some four times as long over them."""
    return _split_words(F.lower(text))


def index_terms(text: Column) -> Column:
    """Distinct terms in order of first appearance: whole words and the components of identifiers."""
    raw = F.filter(F.split(text, r"[^A-Za-z0-9_$À-ɏ]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(raw, lambda w: F.concat(F.array(F.lower(w)), identifier_components(w)))))


def body_terms(text: Column, most: int = 256) -> Column:
    """Identifiers as first written, in first-seen order and distinct whatever their case, without keywords, single bytes and
    what begins with a digit; at most `most` of them, joined by spaces."""
    word = F.lit(r"(?<![\p{L}\p{N}_])(?:[\p{L}_][\p{L}\p{N}_]+|[\p{L}&&[^\x00-\x7F]])")
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), word, F.lit(0))


    def joined(both: Column) -> Column:
        wanted = F.slice(F.array_except(both["lower"], F.array(*map(F.lit, KEYWORDS))), 1, most)
        return F.array_join(F.transform(wanted, lambda w: F.element_at(both["raw"], F.array_position(both["lower"], w).cast("int"))), " ")

    # the words are bound to a variable, so that they are found once
    return F.element_at(F.transform(F.array(F.struct(raw.alias("raw"), F.transform(raw, lambda w: F.lower(w)).alias("lower"))), joined), 1)


def stems(term: Column) -> Column:
    """The term and its conservative stems: plural and common verb endings taken off terms that stay three letters long."""

    def cut(ending: str, to: str = "") -> Column:
        return F.when(term.endswith(ending), F.regexp_replace(term, f"{ending}$", to))

    options = F.array(term, cut("ies", "y"), cut("ing"), cut("ed"), cut("es"), cut("s"))
    return F.array_distinct(F.filter(options, lambda t: t.isNotNull() & ((F.length(t) >= 3) | (t == term))))


def last_segment(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.:/#]+)$", 1)


def path_stem(path: Column) -> Column:
    """File name without directories and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def normal_name(name: Column) -> Column:
    """Lower-cased with white space runs as one space, trimmed."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def humanised(name: Column) -> Column:
    return F.array_join(identifier_components(name, 1), " ")


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_low_value_path(path: Column) -> Column:
    """Tests, fixtures, samples, benchmarks, vendored and generated files."""
    return F.lower(path).rlike(f"{LOW_VALUE_FOLDER}|{LOW_VALUE_FILE}")


def glob_to_regex(glob: str) -> str:
    """A path glob as an anchored regular expression: ** crosses directories, * and ? do not, [a-c] and [!a-c] are one character."""
    import re

    out, i = "", 0
    while i < len(glob):
        held = re.match(r"\[([!^]?)(\]?[^\]/]*)\]", glob[i:])
        if held and held[2]:
            out, i = out + f"[{'^/' if held[1] else ''}{re.sub(r'([\\^&~|[])', r'\\\1', held[2])}]", i + held.end()
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        elif glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def ignore_rule(line: str) -> tuple[str, bool] | None:
    """An ignore file's line as (regular expression of paths, whether it takes paths back); None for comments and blank lines.

    A pattern with a slash inside or in front is bound to the root, others match at any depth; a match covers all that lies below, and
    with a slash at its end only what lies below."""
    line = line.rstrip("\n").rstrip(" ")
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    pattern = line[1:] if back else line
    pattern = pattern[1:] if pattern.startswith("\\") else pattern
    folder = pattern.endswith("/")
    pattern = pattern.rstrip("/")
    rooted = "/" in pattern
    body = glob_to_regex(pattern.lstrip("/"))[1:-1]
    return f"^{'' if rooted else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$", back


def exact_rule(line: str, folder: str = "") -> tuple[str, bool, bool] | None:
    """A line of the ignore file in folder as (regular expression of what it names, whether it takes back, whether it names folders
    only); None for comments and blank lines.  A pattern with a slash inside or in front is bound to the file's folder."""
    line = line.rstrip("\n").rstrip(" ")
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    pattern = line[1:] if back else line
    only_folders = pattern.endswith("/")
    pattern = pattern.rstrip("/")
    rooted = "/" in pattern
    inside = glob_to_regex(folder)[1:-1] + "/" if folder else ""
    return f"^{inside}{'' if rooted else '(?:.*/)?'}{glob_to_regex(pattern.lstrip('/'))[1:-1]}$", back, only_folders


def ignored(path: Column, rules: list[str] | dict[str, list[str]]) -> Column:
    """Whether ignore files leave a path out: lines of one file at the root, or of several by their folders, of which deeper ones go
    before.  The last line that names a path decides; nothing below a folder that is left out can be taken back."""
    files = rules if isinstance(rules, dict) else {"": rules}
    ordered = [(line, folder) for folder in sorted(files, key=lambda f: (f.count("/") + bool(f), f)) for line in files[folder]]
    parsed = [r for line, folder in ordered if (r := exact_rule(line, folder)) is not None]
    parts = F.split(path, "/")
    places = F.sequence(F.lit(1), F.size(parts))

    def out(place: Column) -> Column:
        prefix, is_folder, decided = F.array_join(F.slice(parts, 1, place), "/"), place < F.size(parts), F.lit(False)
        for pattern, back, only_folders in parsed:
            named = prefix.rlike(pattern) & is_folder if only_folders else prefix.rlike(pattern)
            decided = F.when(named, F.lit(not back)).otherwise(decided)
        return decided

    return F.exists(places, out)


def token_estimate(text: Column, by_bytes: bool = False) -> Column:
    """A quarter of the characters, or of the bytes, rounded up."""
    return F.ceil((F.octet_length(text) if by_bytes else F.length(text)) / 4).cast("long")


def excerpt(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def body_hash(body: Column) -> Column:
    """SHA-256 of the text with white space runs as one space."""
    return F.sha2(F.trim(F.regexp_replace(body, r"\s+", " ")), 256)


def node_id(path: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, F.substring(F.sha2(F.concat_ws("|", path, kind, name), 256), 1, 32))


def relocated_ref(old_ref: Column, kind: Column, path: Column, name: Column) -> Column:
    """The readable reference of a node that keeps the old reference's kind where it means the node's."""
    old = F.regexp_extract(old_ref, r"^([a-z_]+):.+:.+$", 1)
    return readable_ref(F.when((old != "") & kinds_equivalent(old, kind), old).otherwise(kind), path, name)


def readable_ref(kind: Column, path: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, path, name)


def kinds_equivalent(a: Column, b: Column) -> Column:
    """Kinds that renames and other languages turn into each other."""
    group = lambda k: F.when(k.isin("function", "method", "fn", "def"), "callable").when(k.isin("struct", "class"), "class").when(k.isin("type", "type_alias"), "type").otherwise(k)
    return group(a) == group(b)


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Similarity of two arrays as sets; `empty` is what two empty sets get."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def idf(documents: Column, frequency: Column) -> Column:
    """Smoothed inverse document frequency, never below 1."""
    return F.log((documents + 1) / (frequency + 1)) + 1


def since(value: str, now: Column) -> Column:
    """The instant of '7d', '12h', a date or a timestamp; relative values count back from now."""
    import re

    if m := re.fullmatch(r"(\d{1,5})([dh])", value):
        if m[2] == "d" and int(m[1]) > 36_500:
            raise ValueError("too many days")
        return now - F.make_interval(**({"days": F.lit(int(m[1]))} if m[2] == "d" else {"hours": F.lit(int(m[1]))}))
    return F.to_timestamp(F.lit(value))
