"""Abusive, hateful or sexual content (problem 10).

A general lexicon of single words is held as a trie. A word of a text that is in no list is matched by a Levenshtein automaton that walks the
trie in step with it: a sign that stands for a letter, a stretched letter and a starred-out letter cost nothing, any other difference an
error, and the errors allowed grow with the length of the term. Spaced-out letters and words broken over lines are put together before.

Matched words carry roles (insult, violence, part of the body, people, degrading word, explicit word ...). What is
scored is the window of one sentence: an insult counts with an address, a threat or a rhetorical question, a degrading word with people
it is said of, an explicit word with others of its field. Words of report, rule, medicine, art, farming or pest control in the same window take from the
score, which parts quotation from abuse. Lexicon, weights and threshold are stated below; they are general, were not
fitted to labels, and depend on no size of the corpus.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import spread

# The lexicon, by role. Single words of English, German, French, Spanish and Norwegian.
LEXICON = {
    "insult": "idiot idiots moron morons imbecile imbeciles cretin cretins loser losers scumbag scumbags lowlife bitch bitches bastard bastards pig pigs asshole assholes shithead dickhead whore slut prick wanker dumbass jerk dimwit halfwit nitwit dunce fool dolt "
    "douchebag motherfucker cocksucker twat tosser arsehole trash shit coward liar "
    "idiota imbécil gilipollas cabrón cabrona pendejo puta zorra mierda estúpido estúpida payaso tonto drittsekk kødd jævel idioten drittunge hore fitte kuksuger tosk arschloch trottel dreckskerl mistkerl schwachkopf idiotin drecksau miststück hure fotze wichser dummkopf scheiße "
    "connard connasse salaud salope abruti crétin crétine imbécile merde ordure pute con enculé",
    "slur": "rotten filthy useless worthless fucking pathetic stupid brainless spineless disgusting lying miserable ugly dumb inútil jævla udugelige stygge dumme dum verdammte verdammter verdammtes dummer dummes blöder blödes dreckiger dreckiges wertloses wertloser inutile pauvre sale stupide asqueroso maldito maldita",
    "violence": "kill killed killing murder break breaking broken choke strangle stab shoot beat smash crush hang burn bury drown drag hunt hurt punch rape die dead slit cut bleed bringe töten umbringen matar matarte tuer crever drepe",
    "body": "legs teeth neck throat bones skull face jaw knees arms fingers mouth head guts boca dents cou hals beine zähne maul kjeft gueule",
    "contempt": "shut hell listen rock crawl nobody regret back miss ferme hold halt cállate verpiss foutre watch",
    "address": "you your you're yourself du din deg dir dein deine deinen tu te ton ta toi eres ti usted vous votre",
    "self": "felt myself feel",
    "group": "immigrants immigrant foreigners refugees gypsies unbelievers infidels jews muslims christians hindus migrants homosexuals gays blacks whites mexicans cripples disabled race faith étrangers immigrés extranjeros inmigrantes innvandrere utlendinger flyktninger ausländer einwanderer flüchtlinge zigeuner tribe",
    "collective": "all every people they them those these their esos ces diese slike",
    "degrade": "vermin parasites subhuman subhumans filth scum skadedyr vermine parasiten ungeziefer untermenschen abschaum alimañas racaille",
    "lowly": "animals disease plague criminals breed inferior rats ratas cockroaches rabbits savages beasts plaga pest swine cleaner purer",
    "destroy": "exterminate exterminated drowned sterilised sterilized deported gassed eradicated annihilated utryddes exterminer exterminarlos ausgerottet vernichtet",
    "expel": "driven shipped locked wiped banned jages vertrieben expelled caged",
    "explicit": "cock cocks pussy ass nipples tits dick cunt fuck fucked orgasm threesome porn hardcore horny blowjob cum xxx licked sex knulle follarte follar ficken baiser handjob masturbate",
    "intimate": "naked nude moaned breasts thighs underwear lover kissed undress panties naken nackt nue desnuda erotic",
    "heat": "hot wet hard rough bed night tonight sweating screaming spent slowly adults live cama lit sengen natten nacht noche nuit",
    "frame": "handbook policy harassment statute counsel assault elements training curriculum definition rules statutory bill committee testified discrimination "
    "clinic cancer patient patients hospital doctor nurse screening surgery medical symptoms anatomy lesson museum marble statue sculpture painting painter gallery exhibition novel poem film scene actor chapter praised artist figure "
    "farm farmer barn warehouse kitchen crop harvest traps exterminator pesticide veterinary quoted quote reported article journalist headline words terms welcomed",
}
KINDS = ("abusive", "hateful", "sexual")
#: A kind is found where a sentence reaches this score.
THRESHOLD = 2.0
#: Weights of the roles, for each kind: of each match, and how many matches count.
WEIGHTS = {
    "abusive": {"insult": (1.3, 2), "censored": (1.0, 2), "slur": (0.6, 1), "violence": (0.8, 2), "body": (0.6, 1), "contempt": (0.4, 2), "address": (0.7, 1), "question": (0.7, 1), "self": (-1.0, 1)},
    "hateful": {"group": (1.0, 1), "named": (0.6, 1), "collective": (0.6, 2), "degrade": (1.2, 2), "lowly": (1.0, 2), "destroy": (1.2, 1), "expel": (0.9, 1), "censored": (1.0, 1)},
    "sexual": {"explicit": (1.3, 3), "intimate": (0.9, 3), "heat": (0.5, 2), "censored": (1.0, 1)},
}
#: What a word of quotation, rule, medicine, art or farming takes from every score of its sentence, and how many count.
FRAME = (2.5, 2)
#: Errors allowed for a term, by its length: none below the first bound, one below the second, else two.
ERRORS = (6, 9)
#: Roles whose terms are matched with errors and disguises, and those matched with disguises only; words of the others are too common to be guessed.
HARSH = ("insult", "slur", "degrade", "destroy", "explicit", "intimate", "group")
PLAIN = ("lowly", "expel", "violence")

# Signs that stand for letters.
_SIGNS = {"$": "s", "@": "a", "0": "o", "1": "il", "3": "e", "!": "i", "|": "il", "¢": "e", "†": "t", "5": "s", "€": "e", "£": "l", "7": "t", "4": "a"}
_BREAK = re.compile(r"(\w)[-¬­] ?\r?\n[> \t]*(?=\w)")
_QUOTES = re.compile(r"\n[> \t]*>[ \t]*")
_TOKEN = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}«»„“”’‘<>…—–"
_STARRED = re.compile(r"[^\W\d_]\*{2,}[^\W\d_]?")
_ENDS = (".", "!", "?", ".\"", ".)", "…")


def errors_for(length: int) -> int:
    return 0 if length < ERRORS[0] else 1 if length < ERRORS[1] else 2


class Trie:
    """Terms as a trie; ``near`` walks it in step with the Levenshtein automaton of a word."""

    def __init__(self, terms):
        # A node: [children, term that ends here or None, least and greatest number of letters still to come].
        self.root: list = [{}, None, 99, 0]
        for t in terms:
            node = self.root
            for k, ch in enumerate(t):
                node[2], node[3] = min(node[2], len(t) - k), max(node[3], len(t) - k)
                node = node[0].setdefault(ch, [{}, None, 99, 0])
            node[1], node[2] = t, 0
        self.most = errors_for(max(map(len, terms), default=0))

    def near(self, word: str) -> list[tuple[int, str]]:
        """(errors, term) of the terms within their bound of errors from ``word``, fewest errors first.

        A sign matches the letters that it stands for, a star any letter, and a letter's repetition nothing, if the word has it three times in a row.
        """
        n, best = len(word), {}
        # A state of the automaton: place in the word and errors so far; with it the node and the last letter taken.
        stack, seen = [(self.root, 0, 0, "")], set()
        free = [k > 1 and word[k] == word[k - 1] and (word[k - 2] == word[k] or k + 1 < n and word[k + 1] == word[k]) or k == 1 and n > 2 and word[0] == word[1] == word[2] for k in range(n)]
        stretch = sum(free)
        while stack:
            node, at, errors, last = stack.pop()
            left = n - at
            if errors + max(node[2] - left, left - stretch - node[3], 0) > self.most:
                continue
            state = (id(node), at, errors)
            if state in seen:
                continue
            seen.add(state)
            if at == n:
                term = node[1]
                if term is not None and errors <= errors_for(len(term)):
                    best[term] = min(errors, best.get(term, 9))
            else:
                c = word[at]
                if free[at] and last and (c == last or last in _SIGNS.get(c, "")):
                    stack.append((node, at + 1, errors, last))
                if c == "*":
                    for ch, child in node[0].items():
                        stack.append((child, at + 1, errors, ch))
                else:
                    child = node[0].get(c)
                    if child is not None:
                        stack.append((child, at + 1, errors, c))
                    for ch in _SIGNS.get(c, ""):
                        child = node[0].get(ch)
                        if child is not None:
                            stack.append((child, at + 1, errors, ch))
            if errors < self.most:
                if at < n:
                    stack.append((node, at + 1, errors + 1, last))
                for ch, child in node[0].items():
                    stack.append((child, at, errors + 1, ch))
                    if at < n and ch != word[at]:
                        stack.append((child, at + 1, errors + 1, ch))
        return sorted((e, t) for t, e in best.items())


class Matcher:
    """Maps words to roles; keeps the answers for words that it has met."""

    def __init__(self, keep: int = 300_000):
        roles: dict[str, set[str]] = defaultdict(set)
        for role, words in LEXICON.items():
            for w in words.split():
                roles[w].add(role)
        self.roles = {w: frozenset(r) for w, r in roles.items()}
        self.harsh = sorted(w for w, r in self.roles.items() if r & {*HARSH, *PLAIN})
        self.trie = Trie(self.harsh)
        self.solid = set(self.harsh)
        self.longest = max(map(len, self.harsh))
        self.keep, self.known = keep, {}

    def word(self, raw: str) -> tuple[str, frozenset] | None:
        """(term, roles) that a raw token stands for, or None."""
        got = self.known.get(raw, 0)
        if got == 0:
            if len(self.known) >= self.keep:
                self.known.clear()
            got = self.known[raw] = self._word(raw)
        return got

    def _word(self, raw: str) -> tuple[str, frozenset] | None:
        w = raw.strip(_EDGE).lower()
        if raw[:1] in "$@!|" or raw[-1:] in "$@|":
            w = raw.strip(_EDGE.replace("!", "")).lower().rstrip("!")
        if w in self.roles:
            return w, self.roles[w]
        if len(w) < 3 or len(w) > 40 or not any(c.isalpha() for c in w):
            return None
        disguised = any(c in _SIGNS or c == "*" for c in w)
        starred = bool(_STARRED.fullmatch(w))
        if "*" in w and not starred:
            w = w.replace("*", "")
        # Names are written with a capital: such a word is guessed only if it is disguised or in capitals throughout.
        if disguised or raw[0].islower() or raw.isupper() or re.search(r"(.)\1\1", w):
            best, fits = None, set()
            for errors, t in self.trie.near(w):
                # Endings of the plural and the like are other words, not misspellings; so is a word that lacks the term's first letter.
                if errors and (not self.roles[t] & set(HARSH) or w.startswith(t) or t.startswith(w) or w[0] != t[0] and not disguised):
                    continue
                fits |= self.roles[t]
                rank = (errors, -len(self.roles[t] & {"insult", "degrade", "explicit"}), t)
                if best is None or rank < best[0]:
                    best = (rank, t)
            if best and starred:
                # Which of the terms it stands for shows in the sentence.
                return w, frozenset({"censored"} | {"?" + r for r in fits})
            if best:
                return best[1], self.roles[best[1]]
        return (w, frozenset({"censored"})) if starred and len(w) > 3 else None

    def spaced(self, letters: str) -> list[tuple[str, frozenset]]:
        """The terms that a run of single letters spells, taken greedily from the left."""
        plain, out, at = "".join(_SIGNS.get(c, c)[0] for c in letters.lower()), [], 0
        while at < len(plain):
            for end in range(min(len(plain), at + self.longest), at + 2, -1):
                if plain[at:end] in self.solid:
                    out.append((plain[at:end], self.roles[plain[at:end]]))
                    at = end
                    break
            else:
                at += 1
        return out


class Scorer:
    def __init__(self):
        self.m = Matcher()

    def sentences(self, text: str) -> Iterator[list[tuple[str, frozenset]]]:
        """Matched terms of each sentence with their roles; a sentence without any is left out."""
        m = self.m
        t = _BREAK.sub(r"\1", text)
        if ">" in t:
            t = _QUOTES.sub("\n", t)
        hits: list[tuple[str, frozenset]] = []
        run, before = "", ""
        known, word = m.known, m.word
        for raw in _TOKEN.findall(t):
            if len(raw) == 1 or (len(raw) == 2 and raw[1] in ",.!?;:"):
                # Possibly a letter of a spaced-out word.
                run += raw[0]
                before = raw
                if len(raw) == 2:
                    if len(run) >= 3:
                        hits += m.spaced(run)
                        if raw[1] in ".!?":
                            if raw[1] == "?":
                                hits.append(("?", _QUESTION))
                            yield hits
                            hits = []
                    run = ""
                continue
            if run:
                if len(run) >= 3:
                    hits += m.spaced(run)
                run = ""
            got = known.get(raw, 0)
            if got == 0:
                got = word(raw)
            if got:
                hits.append(got)
            elif raw[0].isupper() and before in ("the", "The", "THE") and raw[1:2].islower():
                hits.append((raw, _NAMED))  # perhaps a people
            elif raw[0].isupper() and hits and hits[-1] == (before, _NAMED):
                hits.pop()  # the name of a house or place has more words
            before = raw
            if raw.endswith(_ENDS) and not (len(raw) <= 3 and raw[0].isupper()):
                if hits:
                    if "?" in raw[-2:]:
                        hits.append(("?", _QUESTION))
                    yield hits
                    hits = []
        if len(run) >= 3:
            hits += m.spaced(run)
        if hits:
            yield hits

    def sentence_scores(self, hits: list[tuple[str, frozenset]]) -> tuple[float, float, float]:
        terms: dict[str, set[str]] = defaultdict(set)
        for t, roles in hits:
            for r in roles:
                terms[r].add(t)
        if any(r[0] == "?" for r in terms):
            # A starred-out word takes the roles of the kind that the other words of its sentence speak for most, by default insults.
            told = {kind: sum(w * min(len(terms.get(r, ())), most) for r, (w, most) in WEIGHTS[kind].items() if r not in _ANYWHERE) for kind in KINDS}
            kind = max(KINDS, key=lambda k: told[k])
            for r in [r for r in terms if r[0] == "?" and r[1:] in WEIGHTS[kind]]:
                terms[r[1:]] |= terms[r]
        n = {r: len(t) for r, t in terms.items()}
        if not any(n.get(r) for r in _TRIGGERS):
            return 0.0, 0.0, 0.0

        def total(kind: str) -> float:
            return sum(w * min(n.get(r, 0), most) for r, (w, most) in WEIGHTS[kind].items())

        frame = FRAME[0] * min(n.get("frame", 0), FRAME[1])
        abusive = hateful = sexual = 0.0
        aimed = n.get("address") or n.get("violence") or n.get("question") or n.get("contempt")
        if n.get("insult") or n.get("censored") or n.get("violence") and n.get("address") and n.get("body"):
            abusive = total("abusive")
            if not aimed:
                abusive = min(abusive - 0.6, 1.9)
        harm = n.get("degrade", 0) + n.get("destroy", 0)
        if n.get("group") and (harm or n.get("lowly") or n.get("expel") or n.get("censored")) or harm and (n.get("named") or n.get("collective", 0)) or n.get("named") and (n.get("lowly", 0) + n.get("expel", 0) + ("people" in terms["collective"]) > 1 or n.get("collective") and n.get("expel")):
            hateful = total("hateful")
        explicit = terms["explicit"]
        if explicit or n.get("intimate", 0) > 1:
            sexual = total("sexual")
            if n.get("insult") and explicit <= {"ass", "dick", "fuck", "cock", "con"} and not n.get("intimate"):
                sexual = 0.0  # swearing
            if not n.get("intimate") and not n.get("heat") and n.get("explicit", 0) < 2:
                sexual = min(sexual, 1.9)
        return max(abusive - frame, 0.0), max(hateful - frame, 0.0), max(sexual - frame, 0.0)

    def document(self, text: str) -> tuple[float, float, float]:
        """The greatest score of a sentence for each kind."""
        best = (0.0, 0.0, 0.0)
        for hits in self.sentences(text):
            if len(hits) > 1:
                best = tuple(map(max, best, self.sentence_scores(hits)))
        return best


#: Roles that tell nothing of the kind of a sentence.
_ANYWHERE = ("address", "collective", "contempt", "question", "censored", "named", "self")
_QUESTION, _NAMED = frozenset({"question"}), frozenset({"named"})
#: A sentence is scored only if it holds a word of one of these roles.
_TRIGGERS = ("insult", "degrade", "destroy", "explicit", "intimate", "censored", "violence", "lowly", "expel")


def scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, abusive, hateful, sexual (doubles from 0) for every row; null and empty texts score 0; extra columns are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import folioscope.llm.abuse as here

        s = here.Scorer()
        for b in batches:
            made = [s.document(t) if t else (0.0, 0.0, 0.0) for t in b[text]]
            yield pd.DataFrame({key: b[key], **{k: [round(float(x[i]), 3) for x in made] for i, k in enumerate(here.KINDS)}})

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{k} double" for k in KINDS))


def found(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """p10_found: doc_id, kind of every document that holds a passage of the kind; equal rows count once."""
    s = scores(df.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull()))
    kinds = F.array(*[F.when(F.col(k) >= threshold, F.lit(k)) for k in KINDS])
    return s.select("doc_id", F.explode(F.array_compact(kinds)).alias("kind")).distinct()


def rates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a source (null is one): source, documents, and the share of its documents with each kind and with any."""
    s = scores(df).join(df.select("doc_id", "source"), "doc_id")
    over = {k: (F.col(k) >= threshold).cast("double") for k in KINDS}
    return s.groupBy("source").agg(F.count("*").alias("documents"), *[F.avg(c).alias(f"{k}_rate") for k, c in over.items()], F.avg(F.greatest(*over.values())).alias("any_rate"))
