"""Variant spellings of names typed by people (problem 6).

Each name is read into parts: title, given name or initials, middle initial and surname; or the root and the kind of an organisation.
Surnames and roots are compared by suffix blocking: every distinct one is indexed under its suffixes of ``LEAST_SUFFIX`` letters
(fewer in words of under nine) or more, of the word and of its mirror image (typing errors near the end spare the beginning). How many words
share a suffix is counted: one of more than ``COMMON`` words is too common to block by, and is discarded for the same suffix refined with the word's first letter and
the initial of the given name; suffixes of six letters and more are not refined. What is still common is compared in blocks of members against members, so no pair is dropped.
Pairs within a block are compared by the ratio of their longest common subsequence to the longer word.

Persons are surname and given name. Given names are brought to one form through a table of short forms and, for typing errors, the names
that come with many surnames. Names with initials, ambiguous short forms or a title alone are linked only where exactly one person
fits, so different people who share part of a name stay apart. Links are joined by connected components.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from folioscope.llm.groups import components
from folioscope.llm.neardup import blocked
from folioscope.llm.words import lcs
from folioscope.session import cut

LEAST_SUFFIX = 4
#: A suffix that more words share is refined with other fields.
COMMON = 50
#: Least ratio of the longest common subsequence; in words of over five letters one letter of the longer may be missing from it.
LEAST_RATIO = 0.8
#: A given name comes with at least this share of all surnames, and at least three; so their number is bounded by its inverse.
GIVEN_SHARE = 0.002

# Titles, short forms of given names, and words of organisations with their short forms.
TITLES = set("mr ms mrs miss mx dr prof professor hon honourable honorable atty attorney sir dame rev judge sen rep capt col gen lt sgt herr frau fru m mme jr sr esq".split())
SHORT = {
    "abigail": "abby gail", "agnes": "aggie", "albert": "bertie", "alexander": "alex sasha sandy", "amanda": "mandy", "amelia": "millie",
    "andrew": "andy drew", "anthony": "tony", "barbara": "barb babs", "benjamin": "ben benny", "catherine": "cathy kate", "charles": "charlie chuck",
    "christopher": "chris kit topher", "cynthia": "cindy", "daniel": "dan danny", "deborah": "deb debbie", "donald": "don donnie",
    "dorothea": "dot dolly dora thea", "dorothy": "dot dolly", "douglas": "doug", "edward": "ed eddie ned ted", "eleanor": "ellie nora",
    "elizabeth": "beth betsy liz lizzie eliza betty", "eugene": "gene", "florence": "flo", "frederick": "fred freddie fritz",
    "gabriella": "gaby gabi ella", "geoffrey": "geoff", "george": "georgie", "gerald": "gerry", "gregory": "greg", "henrietta": "etta hattie hetty",
    "henry": "harry hank", "ignatius": "iggy", "isabella": "izzy bella", "jacob": "jake", "james": "jim jimmy", "jeffrey": "jeff",
    "jennifer": "jen jenny", "jessica": "jess", "john": "jack johnny", "jonathan": "jon", "joseph": "joe joey", "joshua": "josh", "josé": "pepe",
    "judith": "judy", "katherine": "kathy kate kit katie kathie", "kenneth": "ken", "lawrence": "larry lars", "leonard": "len lenny",
    "margaret": "maggie peggy meg greta", "martin": "marty", "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nate nat",
    "nicholas": "nick", "oliver": "ollie", "orsolina": "lina", "ottilie": "tilly otti", "pamela": "pam", "patricia": "pat trish patty tricia",
    "peter": "pete", "philip": "phil", "quentin": "quin", "raymond": "ray", "rebecca": "becky", "richard": "rick dick rich ricky",
    "robert": "bob bobby rob robbie bert", "ronald": "ron", "samuel": "sam", "sarah": "sally sadie", "sebastian": "seb", "stanley": "stan",
    "stephen": "steve", "susanna": "sue susie suzy", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim", "ursula": "ulla uschi",
    "valerie": "val", "victoria": "vicky tori vic", "vincent": "vince vinny", "virginia": "ginny", "walter": "walt", "william": "will bill billy willie",
    "winifred": "winnie", "yolanda": "yola", "zachary": "zach zack",
}
KINDS_OF_ORG = "foundation university college trust law capital research aviation holdings bank hospital museum society church school press insurance shipping energy media consulting".split()
ORG_SHORT = {"fdn": "foundation", "fndn": "foundation", "found": "foundation", "foundations": "foundation", "univ": "university", "uni": "university", "u": "university", "tr": "trust", "cap": "capital", "capitol": "capital", "res": "research", "avn": "aviation", "av": "aviation", "hldgs": "holdings", "hldg": "holdings", "holding": "holdings", "lawgroup": "law"}
ORG_FORMS = set("inc incorporated llc llp lp l c p pc plc ltd limited co company corp corporation group grp partners ptnrs institute inst of and the office gmbh ag as sa".split())

_FORMAL: dict[str, list[str]] = {}
for _name, _shorts in SHORT.items():
    for _s in _shorts.split():
        _FORMAL.setdefault(_s, []).append(_name)
_DIGITS = str.maketrans({"0": "o", "1": "l", "5": "s", "6": "b", "9": "g", "3": "e", "|": "l", "$": "s", "@": "a"})


def plain(text: str) -> str:
    """Letters without accents, digits within words read as letters."""
    t = unicodedata.normalize("NFKD", text.replace("ø", "o").replace("Ø", "O").replace("æ", "ae").replace("ß", "ss"))
    t = "".join(c for c in t if not unicodedata.combining(c))
    return re.sub(r"(?=\w*[^\W\d_])\w+", lambda m: m[0].translate(_DIGITS), t)


_GIVEN = {plain(n): n for n in SHORT}


def ratio(a: str, b: str) -> float:
    """The longest common subsequence as a share of the longer word; 1 for two empty ones."""
    n = max(len(a), len(b))
    return lcs(a, b) / n if n else 1.0


def close(a: str, b: str) -> bool:
    """Whether the ratio reaches ``LEAST_RATIO``, and in longer words what one error leaves of it: a letter left out, put in or exchanged, or two swapped."""
    n = max(len(a), len(b))
    return a == b or abs(len(a) - len(b)) <= 1 and ratio(a, b) >= max(LEAST_RATIO, 1 - 1 / max(n, 1)) - 1e-9


def _given(word: str, known: dict[str, str]) -> tuple[list[str], bool]:
    """The formal names that a given name may stand for, and whether it was a short form."""
    if word in _FORMAL and word not in known:
        return [plain(x) for x in _FORMAL[word]], True
    if word in _GIVEN or word in known:
        if word in _FORMAL:
            return [plain(x) for x in _FORMAL[word]], True
        return [word], False
    if len(word) >= 3:
        near = sorted({w for w in {*_GIVEN, *known} if w not in _FORMAL and (close(word, w) if max(len(word), len(w)) >= 5 else len(w) >= 3 and lcs(word, w) >= max(len(word), len(w)) - 1 and word[0] == w[0])})
        near = [w for w in near if w in known] or near
        if len(near) == 1:
            return near, False
        short = sorted({f for s, fs in _FORMAL.items() if len(s) >= 5 and close(word, s) for f in fs})
        if not near and short:
            return [plain(x) for x in short], True
    return [word], False


def read_person(text: str, known: dict[str, str]) -> tuple[str, list[str], str, str, str]:
    """(surname, formal given names, initial, middle initial, form) with form one of full, short, initial, none."""
    t = plain(text).replace("’", "'").strip().strip("\"'")
    comma = None
    m = re.match(r"^([^,]+),\s*(.+)$", t)
    if m and m[2].lower().strip(".") not in TITLES:
        comma, t = m[1], m[2]
    words = []
    for w in re.split(r"[\s]+", t):
        dotted = w.endswith(".")
        w = w.strip(".,;()\"")
        if not w:
            continue
        # Two capitals without a full stop are initials, though they may look like a title.
        if w.lower() in TITLES and len(w) > 1 and (dotted or not (len(w) == 2 and w.isupper())):
            continue
        split = re.fullmatch(r"([A-Z][a-z'-]+)([A-Z][a-z'-]+)", w)
        words += [split[1], split[2]] if split and len(split[1]) > 2 and len(split[2]) > 2 and not w.startswith(("Mc", "Mac")) else [w]
    if comma is not None:
        surname = comma
    elif not words:
        return "", [], "", "", "none"
    elif len(words) == 1:
        return _root(words[0]), [], "", "", "none"
    else:
        first, last = words[0].lower(), words[-1].lower()
        is_given = lambda w: w in known or w in _GIVEN or w in _FORMAL
        if len(words) == 2 and len(last) > 2 and is_given(last) and not is_given(first) and len(first) > 3:
            surname, words = words[0], words[1:]
        elif len(words) == 2 and len(first) > 3 and len(last) > 3 and not is_given(first) and not is_given(last) and not _like_given(first, known) and _like_given(last, known):
            surname, words = words[0], words[1:]
        else:
            surname, words = words[-1], words[:-1]
    root = _root(surname)
    if not words:
        return root, [], "", "", "none"
    g = words[0]
    middle = next((w[0].lower() for w in words[1:] if w), "")
    if len(g) == 1:
        return root, [], g.lower(), middle, "initial"
    if len(g) == 2 and g.isupper():
        return root, [], g[0].lower(), g[1].lower(), "initial"
    if re.fullmatch(r"(?:[A-Za-z]\.)+[A-Za-z]", g):
        return root, [], g[0].lower(), g[2].lower(), "initial"
    formal, short = _given(re.sub(r"[^a-z]", "", g.lower()), known)
    return root, formal, formal[0][:1], middle, "short" if short and len(formal) > 1 else "full"


def _like_given(word: str, known: dict[str, str]) -> bool:
    formal, _ = _given(word, known)
    return formal != [word]


def _root(surname: str) -> str:
    return re.sub(r"[^a-z]", "", surname.lower())


def read_organisation(text: str) -> tuple[str, str]:
    """(root, kind): the words before the first that tells the kind, and the kinds; legal forms and short forms make no difference."""
    words = [w for w in re.split(r"[^\w]+", plain(text).lower().replace(".", " " if re.search(r"\b\w\.\w\.", text) else "")) if w]
    if words and words[0] == "the" and len(words) > 1:
        words = words[1:]
    root, kinds, rest = [], [], []
    for k, w in enumerate(words):
        kind = ORG_SHORT.get(w) or (w if w in KINDS_OF_ORG else next((x for x in KINDS_OF_ORG if len(w) >= 6 and close(w, x)), None))
        if kind == "press" and kinds:
            kind = None
        elif k and kind:
            kinds.append(kind)
        elif k and (w in ORG_FORMS or any(len(w) >= 6 and close(w, x) for x in ("company", "institute", "partners", "incorporated"))):
            rest.append(w)
        elif not kinds and not rest:
            root.append(w)
    return "".join(root), " ".join(sorted(set(kinds))) or " ".join(sorted(set(rest) - {"inc", "incorporated", "llc", "l", "c", "ltd", "co", "corp", "lp", "pc", "p"}))


def _parse(rows: DataFrame, known: dict[str, str]) -> DataFrame:
    """kind, id, type, root, cls, given, ini, mid, form of every name that could be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import folioscope.llm.names as here

        for b in batches:
            out = []
            for kind, i, type_, text in zip(b["kind"], b["id"], b["type"], b["name"], strict=True):
                if type_ == "organization":
                    root, cls = here.read_organisation(text)
                    made = (root, cls, [cls], "", "", "full")
                else:
                    root, formal, ini, mid, form = here.read_person(text, known)
                    made = (root, "", formal, ini, mid, form)
                if root:
                    out.append((kind, i, type_, *made))
            if out:
                yield pd.DataFrame(out, columns=["kind", "id", "type", "root", "cls", "given", "ini", "mid", "form"])

    return rows.mapInPandas(run, "kind string, id long, type string, root string, cls string, given array<string>, ini string, mid string, form string")


def given_names(rows: DataFrame) -> dict[str, str]:
    """First words of two-word names that come with at least ``GIVEN_SHARE`` of all second words, and with three."""
    words = F.split(F.lower(F.regexp_replace("name", r"[.\"]", "")), r"\s+")
    two = rows.filter("type = 'person'").select(words.alias("w")).filter("size(w) = 2 and not contains(w[0], ',')").select(F.col("w")[0].alias("a"), F.col("w")[1].alias("b")).filter("length(a) > 2").distinct()
    n = two.select("b").distinct().count()
    least = max(3, int(GIVEN_SHARE * n))
    kept = two.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= least).collect()
    n_of: dict[str, int] = {}
    for r in kept:
        k = re.sub(r"[^a-z]", "", plain(r["a"]).lower())
        if k and k not in TITLES:
            n_of[k] = n_of.get(k, 0) + r["n"]
    # A frequent typing error of a more frequent name, or of one in the table, is no name.
    formal = set(_GIVEN)
    return {k: k for k, c in n_of.items() if k in formal or k in _FORMAL or not any(k != v and close(k, v) and (v in formal or n_of.get(v, 0) >= 5 * c) for v in {*formal, *n_of})}


def near_roots(roots: DataFrame, common: int = COMMON) -> DataFrame:
    """type, cls, r, s: pairs of different roots of one type and class that are close; both directions."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import folioscope.llm.names as here

        for b in batches:
            out = []
            for type_, cls, root, ini in zip(b["type"], b["cls"], b["root"], b["ini"], strict=True):
                out += [(type_, cls, root, tail, fine) for tail, fine in here.suffixes(root, ini)]
            if out:
                yield pd.DataFrame(out, columns=["type", "cls", "root", "tail", "fine"])

    initials = F.when(F.size("given") > 0, F.transform("given", lambda g: F.substring(g, 1, 1))).otherwise(F.array("ini"))
    where = ["type", "cls"]
    tails = cut(roots.select(*where, "root", F.explode(initials).alias("ini")).distinct().mapInPandas(blocks, "type string, cls string, root string, tail string, fine string").distinct())
    # A suffix of one word makes no pair; a common one gives way to its refined form.
    words = tails.select(*where, "tail", "root").distinct().groupBy(*where, "tail").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = tails.join(words, [*where, "tail"]).select(*where, "root", F.when(F.col("n") <= common, F.col("tail")).otherwise(F.col("fine")).alias("key")).distinct()
    keyed = cut(keyed)
    size = keyed.groupBy(*where, "key").agg(F.count("*").alias("m")).filter("m > 1")
    left, right = blocked(keyed.join(size, [*where, "key"]), "key", "root", "m")
    on = [*where, "key", "_i", "_j"]
    pairs = left.select(*on, F.col("root").alias("r")).join(right.select(*on, F.col("root").alias("s")), on)
    pairs = pairs.filter((F.col("r") < F.col("s")) & (F.abs(F.length("r") - F.length("s")) <= 1)).filter(F.levenshtein("r", "s", 2) >= 0).select(*where, "r", "s").distinct()

    @F.pandas_udf(BooleanType())
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        import folioscope.llm.names as here

        return pd.Series([here.close(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

    pairs = pairs.filter(alike("r", "s"))
    return cut(pairs.unionByName(pairs.select(*where, F.col("s").alias("r"), F.col("r").alias("s"))))


def suffixes(root: str, ini: str) -> set[tuple[str, str]]:
    """Suffixes of a word and of its mirror image, each with its form refined, if it is short, by what an error in the middle spares: the first letter of the word and of the given name."""
    n, out = len(root), set()
    for mark, w in (("<", root), (">", root[::-1])):
        for size in range(min(LEAST_SUFFIX, max(2, (n - 1) // 2)), n + 1):
            tail = mark + w[n - size :]
            # An error in the first letter spares only a long suffix, which stays as it is.
            out.add((tail, tail if size >= 6 or size >= n - 1 else f"{tail}/{w[0]}/{ini}"))
    return out


def clusters(entities: DataFrame, canonicals: DataFrame) -> DataFrame:
    """kind, id, who: who is equal for ids that name the same person or organisation; every id of those types with a name."""
    both = ("person", "organization")
    e = entities.filter(F.col("type").isin(*both)).select(F.lit("entities").alias("kind"), F.col("entity_id").alias("id"), "type", F.coalesce("text", "normalized_text").alias("name"))
    c = canonicals.filter(F.col("entity_type").isin(*both)).select(F.lit("canonicals").alias("kind"), F.col("canonical_id").alias("id"), F.col("entity_type").alias("type"), F.coalesce("canonical_text", "canonical_normalized").alias("name"))
    rows = e.unionByName(c).filter("id is not null and trim(name) <> ''").distinct()
    known = given_names(rows)
    parsed = cut(_parse(rows, known))
    # Vertices: a node is a distinct reading, a person is surname (or root and class) with given name.
    node = F.xxhash64(F.lit("node"), "type", "root", "cls", "given", "ini", "mid", "form")
    person = lambda root, given: F.xxhash64(F.lit("person"), "type", root, "cls", given)
    nodes = cut(parsed.select("type", "root", "cls", "given", "ini", "mid", "form").distinct().withColumn("node", node))
    full = nodes.filter("form = 'full'").withColumn("g", F.col("given")[0])
    near = near_roots(nodes)
    persons = cut(full.select("type", "cls", "root", "g", "mid").distinct())
    who = persons.select("type", "cls", "root", "g").distinct()
    links = full.select(F.col("node").alias("u"), person("root", "g").alias("v"))
    # Persons of one given name whose surnames are close.
    other = who.select("type", "cls", F.col("root").alias("s"), "g")
    same = who.join(near, (who["root"] == near["r"]) & (who["type"] == near["type"]) & (who["cls"] == near["cls"])).select(who["type"], who["cls"], who["root"], who["g"], near["s"])
    same = same.join(other, ["type", "cls", "s", "g"])
    links = links.unionByName(same.select(person("root", "g").alias("u"), person("s", "g").alias("v")))
    # Names that tell less: linked to the only person that fits, of the same surname if there is any, else of a close one.
    part = nodes.filter("form <> 'full'")
    reach = part.select("type", "cls", "root", "given", "ini", "mid", "form", "node", F.col("root").alias("s"), F.lit(0).alias("far")).unionByName(
        part.join(near.withColumnsRenamed({"type": "_t", "cls": "_c"}), (F.col("root") == F.col("r")) & (F.col("type") == F.col("_t")) & (F.col("cls") == F.col("_c"))).select("type", "cls", "root", "given", "ini", "mid", "form", "node", "s", F.lit(1).alias("far"))
    )
    p = persons.select(F.col("type").alias("_t"), F.col("cls").alias("_c"), F.col("root").alias("_r"), F.col("g").alias("_g"), F.col("mid").alias("_m"))
    fits = reach.join(p, (F.col("type") == F.col("_t")) & (F.col("cls") == F.col("_c")) & (F.col("s") == F.col("_r")))
    fit = F.when(F.col("form") == "none", True).when(F.col("form") == "short", F.array_contains("given", F.col("_g"))).otherwise(F.col("_g").startswith(F.col("ini")))
    # A middle initial that both have must be equal; persons whose middle initial agrees go before those without.
    agree = F.when((F.col("mid") != "") & (F.col("_m") == F.col("mid")), 0).when((F.col("mid") == "") | (F.col("_m") == ""), 1).otherwise(2)
    fits = fits.filter(fit).withColumn("_a", agree)
    ranked = fits.groupBy("node", "type", "cls", "s", "_g", "far").agg(F.min("_a").alias("a"), F.max(F.when(F.col("_a") == 2, 1).otherwise(0)).alias("conflict")).filter("a < 2")
    order = F.struct("far", F.when((F.col("a") == 0), 0).otherwise(1).alias("k"))
    best = ranked.groupBy("node").agg(F.min(order).alias("o"))
    chosen = ranked.join(best, "node").filter(order == F.col("o"))
    # Close surnames of one given name are one person: they do not make a choice ambiguous.
    only = chosen.groupBy("node").agg(F.countDistinct("_g").alias("n"), F.min(F.struct("type", "cls", "s", "_g")).alias("p")).filter("n = 1").select("node", "p.*")
    links = links.unionByName(only.select(F.col("node").alias("u"), person("s", "_g").alias("v")))
    # Initials that no person fits are compared with each other; so are equal readings of other forms, by their node.
    left = cut(part.filter("form = 'initial'").join(ranked.select("node").distinct(), "node", "left_anti"))
    l, r = left.select("type", "cls", "root", "ini", "mid", "node"), left.select("type", "cls", F.col("root").alias("s"), "ini", F.col("mid").alias("_m"), F.col("node").alias("_n"))
    close_ = near.select("type", "cls", F.col("r").alias("root"), "s").unionByName(left.select("type", "cls", "root", F.col("root").alias("s")).distinct())
    alike = l.join(close_, ["type", "cls", "root"]).join(r, ["type", "cls", "s", "ini"]).filter("node < _n and (mid = _m or mid = '' or _m = '')")
    links = links.unionByName(alike.select(F.col("node").alias("u"), F.col("_n").alias("v")))
    # A canonical record may have several names; nodes without any link are their own.
    many = parsed.withColumn("node", node).select(F.col("node").alias("u"), F.when(F.col("kind") == "canonicals", F.xxhash64(F.lit("record"), "id")).otherwise(F.col("node")).alias("v"))
    comp = components(links.unionByName(many.distinct()), "u", "v")
    at = parsed.withColumn("node", node).select("kind", "id", "node").distinct()
    return at.join(comp, F.col("node") == F.col("x")).select("kind", "id", F.col("rep").alias("who")).distinct()


def found(entities: DataFrame, canonicals: DataFrame, salts: int = 8) -> DataFrame:
    """p6_found: kind, id_a < id_b of ids that name the same person or organisation.

    Names that are null in one column are taken from the other; null and blank names, and other types, have no pair.
    The pairs of one cluster are made by a join that is salted on one side, as a cluster may hold a third of all ids.
    """
    c = cut(clusters(entities, canonicals))
    a = c.select("kind", "who", F.col("id").alias("id_a"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("_s"))
    b = c.select("kind", "who", F.col("id").alias("id_b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    return a.join(b, ["kind", "who", "_s"]).filter("id_a < id_b").select("kind", "id_a", "id_b").distinct()


def linked(entities: DataFrame, canonicals: DataFrame) -> DataFrame:
    """p6_linked: kind, id, group_id (the smallest id of its kind that names the same), names (how many ids the group has)."""
    c = clusters(entities, canonicals)
    g = c.groupBy("kind", "who").agg(F.min("id").alias("group_id"), F.count("*").alias("names"))
    return c.join(g, ["kind", "who"]).select("kind", "id", "group_id", "names")
