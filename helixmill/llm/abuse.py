"""Abusive, hateful and sexual remarks (problem 10): a weighted lexicon, matched by Aho-Corasick in folded text.

Folding undoes what hides a word: compatibility forms, accents, invisible characters, look-alike letters of other scripts,
digits and signs for letters, stretched letters, letters set apart by blanks or dots, letters starred out, and two letters
swapped. Anything beyond plain folding (all but the first three) is done only where it gives a word of the lexicon.

The lexicon has words and short idioms by category, most of them too light to make a case alone: an insult needs somebody it is
said to, a verdict a group, a threat a body or a home. A remark is what stands between sentence ends. Its weight is normalised by
length: it is the largest sum of distinct terms, outside exception phrases, in any WIDTH words in a row, and CURT times the sum
in a remark of one or two words. A document is a case if one of its remarks weighs at least THRESHOLD. The score is the document's whole weight for 100 words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 1.0

#: Look-alikes of Latin small letters.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝвкмнтгзбьӏўєαβεικνορτυχγωηıłøđħɑɡℓ",
    "aeopcyxijshdqwbkmhtrz6blyeabeiknoptuxywnilodhagl",
)
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e", "£": "l", "¡": "i"}

#: Words of a remark that are weighed together.
WIDTH = 24
#: A remark of one or two words weighs so many times its terms: there is nothing but the insult.
CURT = 1.7

# Terms by weight, parted by commas. A cue tells that a person is meant; the heaviest counts, and a second one half.
CUES = (0.4, """you, your, yours, yourself, u, ur, he is, she is, he was, she was, him, her, whoever, someone like, such a, such an, what a, like you, like him, like her, i will, i ll, i am going to, i m going to, i swear, gonna,
that woman, that man, that guy, this guy, those guys, these guys, colleague, colleagues, postdoc, student, intern, professor, supervisor, boss, manager, technician, secretary, coordinator, reviewer, editor, author, director, team, nobody, no one, us all a favour, us all a favor, the world a favour, the world a favor,
du, dich, dir, dein, deine, tu, toi, ton, ta, eres, te, ellos, ils, sie sind, ellas""")
SELF = (-0.5, "i am, i m, i was, i feel, my own, myself, of me, of mine")
NOUNS = (0.6, """idiot, moron, imbecile, cretin, dimwit, halfwit, half wit, loser, clown, parasite, scum, vermin, cockroach, leech, toad, coward, weasel, maggot, swine, lowlife, jackass, nitwit, dunce, fool, nobody likes you, nothing but a,
buffoon, degenerate, psycho, creep, pervert, liar, fraud, crook, piece of garbage, piece of trash, piece of filth, waste of air, excuse for a, airhead, simpleton, numbskull, prick, jerk, thug, brute, subhuman, tosser, scoundrel, rascal, failure, nutcase,
imbeciles, idiots, morons, losers, clowns, parasites, cockroaches, leeches, liars, cowards, dimwits, cretins, thieves, savages, maggots, fools, creeps, perverts, frauds, criminals, blockhead, dullard, pig headed, pigheaded, witch, hag, slob, oaf, dirtbag,
lunatic, sociopath, bigot, sissy, weakling, wimp, crybaby, snob, hypocrite, backstabber, traitor, sleazebag, crone, bimbo, freak, freaks, beast, beasts, scrounger, scroungers, hooligan, rat face, bootlicker, ass kisser, good for nothing, dumb as, more brains than, brains than you""")
ANIMALS = (0.4, "pig, rat, ape, cow, dog, snake, donkey, goat, monkey, pigs, rats, apes, cows, dogs, snakes, monkeys, sheep, worm, insect, insects, cur, animals, worms, hyena, vulture, slug, cockroach like")
ADJECTIVES = (0.35, """stupid, dumb, brainless, spineless, slimy, filthy, worthless, pathetic, useless, disgusting, miserable, lying, rotten, arrogant, greasy, brain dead, braindead, two faced, lazy, ugly, crippled, creepy, dishonest, disgusts me, disgust me,
retarded, demented, moronic, idiotic, vile, sick, repulsive, incompetent, inbred, smelly, stinking, fat, dirty, nasty, cowardly, ignorant, hideous, gutless, witless, clueless, mindless, shameless, heartless, talentless, cheating, thieving, whining, sniveling, sneaky,
brains, pity, ashamed, embarrassment, disgrace, joke of a, stink, stinks, stupidest, dumbest, laziest, ugliest, twice as ugly, nobody can stand, can stand you, hate you, despise you""")
STRONG = (1.0, """fuck you, fuck, fucker, fucking, fucked, motherfucker, cunt, asshole, arsehole, assholes, bitch, bitches, whore, whores, slut, sluts, faggot, faggots, nigger, niggers, kike, chink, tranny, retard, retards, piece of shit, sack of shit, full of shit, shithead, dickhead, cocksucker,
bastard, bastards, scumbag, dumbass, douchebag, wanker, twat, son of a bitch, waste of oxygen, waste of space, waste of skin, go to hell, watch your back, eat shit, shut your mouth, kill yourself, kys, drop dead, rot in hell, hang yourself, human garbage, human trash, human waste, spastic, jerkoff""")
RUDE = (0.6, """shut up, shut it, get lost, get out, piss off, go back to, where you belong, your mother, your mum, your mom, than you, wish you were, hope you, wish you, deserve to be, deserves to be, why are you even, why do you even, who hired you, who let you, never have been born, never wake up,
miss you, cry for you, where you live, you will regret, you will pay, you ll regret, you ll pay, you are dead, you re dead, better run, be sorry, come for you, find you, wait for you, waiting for you, get you, push you, drag you, throw you, teach you, follow you, bullet, bullets""")
#: What a wish or a question of RUDE may go on with.
FATE = (0.4, "die, dies, dead, choke, rot, suffer, bleed, burn, cancer, drown, paid, hired, employed, alive, born, live, by the hair, in the face, down the stairs, from the roof, out of the window, like a dog, like dogs, beaten, grave, funeral")
SEXUAL = (1.0, """tits, boobs, masturbate, masturbating, pussy, blowjob, handjob, jerk off, horny girl, horny boy, so horny, porn, dildo, gangbang, nudes, have sex with, sex with you, sex with me, spread your legs, sit on my face, deepthroat, cumshot, cum on, rape, rape you, raped you, gang rape, touch yourself, grope, groping,
undress for, take off your, get naked, see you naked, naked with, naked in my, nude pictures, nude photos, naked pictures, naked photos, naked selfie, nude selfie, my cock, your cock, my dick, your dick, your ass, your tits, your breasts, your nipples, lick my, lick you, lick your, lick her, suck my, suck your, suck him, suck me, fuck me,
on my lap, feel you up, rub myself, rub yourself, touch myself, make love to, bend you over, bend over for, slept with the, your panties, my pants, her panties, wet for me, hard for you, inside you, turn me on, turns me on, spank you, spank me, undress you, strip you, caress you, kiss you all over""")
SUGGESTIVE = (0.4, "naked, nude, tonight, sweetie, honey, darling, babe, baby girl, hotel room, my place, my bed, in bed, sexy, sexual, lips, thighs, legs, hips, knees, wet, moan, moaning, lick, strip, undress, caress, kiss, spank, grab, your body, body of yours, picturing, fantasy, fantasies, imagine you, dream of you, alone with, watch you, want you, dark room, lingerie, underwear, orgasm, erection")
GROUPS = (0.45, """foreigners, immigrants, migrants, refugees, women, females, girls, blacks, black people, white people, arabs, asians, africans, jews, muslims, christians, hindus, believers, gypsies, roma people, gays, gay people, lesbians, homosexuals, trans people, queers, the disabled, disabled people, the blind, the deaf, cripples, crippled people,
old people, old folks, the elderly, the poor, the homeless, peasants, those people, these people, people of that, people of this, people from the, their whole, whole nation, whole tribe, tribe, race, their kind, foreign students, people like, men like, women like, that religion, their religion, that faith, their faith, auslander, fluchtlinge, ces gens, esa gente, les etrangers, los extranjeros""")
VERDICTS = (0.6, """filth, a disease, animals by nature, born stupid, born criminals, too dumb, too stupid, no business, do not belong, does not belong, don t belong, doesn t belong, locked away, locked up, thrown out, kicked out, wiped out, exterminated, eradicated, deported, sterilised, sterilized, castrated, whipped, be beaten, all thieves, all criminals, all liars, put down,
sick dogs, inferior, by nature, plague, out of pity, not welcome, breed, breeds, ruin everything, ruining everything, let them near, near the, belong in the kitchen, stay in the kitchen, to the kitchen, a curse, a burden, a stain, be shot, be hanged, be gassed, not exist, never hire, not human, get rid of, cleanse, no place for, back where, not deserve, don t deserve, want your, your kind""")
VIOLENT = "smash, break, cut, slit, slash, crush, punch, kick, rip, snap, knock out, stab, burn, burn down, shoot, strangle, choke, beat, hurt, kill, poison, slap, smack, whip, torture, gut, skin, drown, hang, bury, cripple, murder, hunt down, run over, blow up, set fire to, beat up, bash, smother, behead"
TARGETS = "face, head, skull, teeth, legs, arms, neck, throat, jaw, nose, fingers, bones, knees, ribs, eyes, kneecaps, house, home, car, tyres, tires, bike, coffee, tea, food, lunch, family, kids, children, wife, husband, dog, cat, desk"
HARM_YOU = (1.0, "make you bleed, make you suffer, make you pay, make you cry, make you beg, beat you, hurt you, kill you, stab you, strangle you, choke you, shoot you, murder you, bury you, cripple you, skin you, punch you, smash you, slap you, poison you, burn you, drown you, hang you, rape you, end you, bash you, torture you, whip you, hunt you, run you over, set you on fire, throw acid")
OTHER_TONGUES = (1.0, """vollidiot, drecksack, arschloch, wichser, hurensohn, fotze, schlampe, missgeburt, untermensch, halt die klappe, halts maul, ungeziefer, zieh dich aus, fick dich, verpiss dich, leck mich am, dreckskerl, miststuck, abschaum, blode kuh, dumme kuh, dumme sau, nacktfotos,
connard, connasse, salope, salaud, encule, putain de, ta gueule, la gueule, pauvre con, sale con, sale conne, fils de pute, nique ta mere, sous merde, pendejo, cabron, gilipollas, hijo de puta, puta, zorra, maricon, malparido, vete a la mierda, pedazo de mierda, follarte, chupame,
stronzo, vaffanculo, puttana, troia, coglione, testa di cazzo, pezzo di merda, filho da puta, vai se foder, arrombado, kurwa, skurwysyn, spierdalaj, klootzak, kankerlijer, сука, блядь, хуй, мудак, пидор, убью тебя, иди нахуй, дебил, тварь,
傻逼, 操你妈, 他妈的, 去死, 王八蛋, 混蛋, 滚蛋, 白痴, 蠢货, 婊子, 贱人, 杀了你, 裸照, 脱光, 弱智, 打断你, 死ね, くたばれ, 씨발, 개새끼""")
OTHER_WORDS = (0.6, """klappe, fresse, maul, zahne, prugeln, verprugeln, bring dich um, versager, trottel, depp, mistkerl, rausgeworfen, hau ab, imbecil, idiota, inutil, basura, escoria, mierda, merde, callate, infierno, vete, te voy a, desnuda, desnudo, asqueroso,
ferme la, espece de, espece d, gueule, bouffon, ordure, vermine, cretin, je vais te, toute nue, dehors, sers a rien, sert a rien, degage, idiota, ti ammazzo, stupido, seu idiota, te matar, scheisse, scheiss""")
#: Words that are harmless without another of OTHER_WORDS.
OTHER_LIGHT = (0.4, "dreck, dumm, ekelhaft, nackt, umbringen, tuer, casser, frapper, nue, matar, romper, partir, cara")
#: Things that the adjectives are often said of; with one of these next to it an adjective says nothing about a person.
THINGS = "script, tool, file, files, bug, bugs, sample, samples, result, results, code, pipeline, build, aligner, index, table, plot, model, figure, error, question, mistake, idea, reason, freezer, machine, run, job, parser, data, label, labels, list, sheet, workaround, hack, format, typo, baseline, terminal, read, reads, filter, buffer, cell, cells, evaluation, loading, cow milk, trick, detail, surprise, day, night, week, leave, joke"
#: Phrases in which a term says nothing about a person, or says it politely.
EXCEPTIONS = """bastard of a, idiot proof, naked mole rat, naked eye, naked plasmid, nude mice, nude mouse, breast tissue, breast cancer, rat samples, rat sample, rat tissue, rat brain, rat liver, rat cells, rat serum, pig tissue, pig samples, pig liver, pig serum, cow tissue, cow milk, dog tissue, guinea pig, lab rat, lab rats, sheep serum, monkey cells,
monkey patch, snake plot, worm count, pipe worm, parasite load, parasite genome, parasite counts, sexual dimorphism, sexual reproduction, or sexual, sexual remarks, sex linked, sex chromosome, sick leave, dead on arrival, fat client, cash cow, fraud check, fraud detection, plague bacterium, horny layer, thank you, thanks to you, for you, you were right,
miss your, get your, get you started, get you the, get you a, help you, find you a, find you the, send you, near the end, near the door, near the window, race condition, race conditions, hope you are, hope you re, hope you have, hope you like, hope you can, hope you get, wish you a, wish you all, bullet point, bullet points, bullet list, get rid of the, animals by, break your build, kill your job, kill your run, kill your process"""


def _terms(lists: tuple[tuple[float, str], ...]) -> dict[str, float]:
    out: dict[str, float] = {}
    for w, text in lists:
        for t in text.replace("\n", " ").split(","):
            if t.strip():
                out[t.strip()] = max(w, out.get(t.strip(), 0.0))
    return out


def _list(text: str) -> list[str]:
    return [x.strip() for x in text.replace("\n", " ").split(",") if x.strip()]


def default_lexicon() -> "Lexicon":
    terms = _terms((NOUNS, ANIMALS, ADJECTIVES, STRONG, RUDE, FATE, SEXUAL, SUGGESTIVE, GROUPS, VERDICTS, HARM_YOU, OTHER_TONGUES, OTHER_WORDS, OTHER_LIGHT, SELF))
    terms |= {f"{v} {b} {t}": 1.0 for v in _list(VIOLENT) for b in ("your", "both your") for t in _list(TARGETS)}
    harmless = [*_list(EXCEPTIONS), *(f"{a} {t}" for a in _list(ADJECTIVES[1]) if " " not in a for t in _list(THINGS))]
    return Lexicon(terms, _terms((CUES,)), harmless)


class Forms:
    """A trie of words as runs of equal letters. Read with it, a run of three or more letters stands for one or two of them and
    a character for any of its letters, so that no number of runs, of choices or of characters is too large."""

    def __init__(self, forms: dict[str, str]):
        self.kids: list[dict[str, list[tuple[int, int]]]] = [{}]  # of a node by letter: (times, node)
        self.times, self.letter, self.word = [0], [""], [""]
        self.rank: list[tuple[bool, int, str]] = [(True, 0, "")]
        for form, word in sorted(forms.items()):
            at = 0
            for m in re.finditer(r"(.)\1*", form):
                x, k = m[1], len(m[0])
                to = next((n for t, n in self.kids[at].get(x, ()) if t == k), None)
                if to is None:
                    to = len(self.kids)
                    self.kids[at].setdefault(x, []).append((k, to))
                    self.kids.append({})
                    self.times.append(k)
                    self.letter.append(x)
                    self.word.append("")
                    self.rank.append((True, 0, ""))
                at = to
            self.word[at], self.rank[at] = word, (form != word, -len(form), form)

    @staticmethod
    def runs(some: list[str]) -> list[int]:
        """Where the run of equal characters at each place ends."""
        out = list(range(1, len(some) + 1))
        for i in range(len(some) - 2, -1, -1):
            if some[i] == some[i + 1]:
                out[i] = out[i + 1]
        return out

    def longest(self, some: list[str], start: int, runs: list[int]) -> tuple[int, str | None]:
        """(end, word) of the longest stretch from start that gives a word, of several words the first that isn't swapped, the
        longest, the alphabetically first. A state is a node and how often its letter was read, as far as that matters."""
        states, best, i, n = {(0, 0)}, (start, None), start, len(some)
        while i < n and states:
            new = set()
            for at, read in states:
                times = self.times[at]
                whole = read == times or (read >= 3 and times <= 2)
                for x in some[i]:
                    if at and x == self.letter[at]:
                        new.add((at, min(read + 1, max(times, 2) + 1)))
                    elif whole:
                        new.update((to, 1) for _, to in self.kids[at].get(x, ()))
            i += 1
            if new == states:  # nothing changes while the same character goes on
                i = runs[i - 1]
            states = new
            ends = [at for at, read in states if self.word[at] and (read == self.times[at] or (read >= 3 and self.times[at] <= 2))]
            if ends:
                best = (i, self.word[min(ends, key=self.rank.__getitem__)])
        return best


class Lexicon:
    """Terms with weights and exception phrases, all folded; a phrase is a run of words."""

    def __init__(self, terms: dict[str, float], cues: dict[str, float], exceptions: list[str]):
        import ahocorasick

        def fold(t: str) -> str:
            return " ".join(re.findall(r"[^\W_]+", spread(plain(t))))

        self.weights: dict[str, float] = {}
        for t, w in terms.items():
            self.weights[fold(t)] = max(w, self.weights.get(fold(t), 0.0))
        self.cues = {fold(t): w for t, w in cues.items() if fold(t) not in self.weights}
        self.words = {x for p in (*self.weights, *self.cues) for x in p.split()}
        self.hidden = {x for p, w in self.weights.items() for x in p.split() if len(x) > 2 and x not in COMMON}
        self.swapped = {x[:i] + x[i + 1] + x[i] + x[i + 2 :]: x for x in sorted(self.hidden) if len(x) > 3 for i in range(len(x) - 1) if x[i] != x[i + 1]}
        self.swapped = {k: v for k, v in self.swapped.items() if k not in self.words and k not in COMMON} | {"yuo": "you", "oyu": "you"}
        self.forms = Forms({**self.swapped, **{x: x for x in self.words}})
        self.automaton = ahocorasick.Automaton()
        for t, w in (*self.weights.items(), *self.cues.items()):
            self.automaton.add_word(f" {t} ", (t, w))
        for e in exceptions:
            if (f := fold(e)) and f not in self.weights and f not in self.cues:
                self.automaton.add_word(f" {f} ", (f, 0.0))
        self.automaton.make_automaton()
        self.known: tuple[dict[str, str], dict[str, str]] = ({}, {})  # folded words, for texts of other scripts apart

    def look(self, w: str, foreign: bool) -> str:
        """The folded word."""
        t = w.translate(LOOKALIKES) if not w.isascii() and (not foreign or re.search("[a-z]", w)) else w
        got = t if len(t) == 1 and t.isalpha() else "\x00" if END.fullmatch(t) else self._token(t)
        table = self.known[foreign]
        if len(table) >= 200_000:
            table.clear()
        if len(w) <= 100:
            table[w] = got
        return got

    def _token(self, t: str) -> str:
        """A word of the lexicon that the token hides, or the token."""
        if t in self.words:
            return t
        if "*" in t:
            m = re.fullmatch(r"([^\W\d_]+)\*+([^\W\d_]*)", t)
            if m:
                fit = [x for x in self.hidden if x.startswith(m[1]) and x.endswith(m[2]) and len(x) > len(m[1]) + len(m[2])]
                if fit and (m[2] or len(m[1]) > 1):
                    return max(fit, key=lambda x: (self.weights.get(x, 0.0), -len(x), x))
            return t.replace("*", "")
        if re.search(r"[0-9@$!+|€£¡]", t) and (re.search(r"[^\W\d_]", t) or re.search(r"[@$]{2}", t)):
            return self._whole([LEET.get(c, c) for c in t]) or self._letters(t) or t
        return self._letters(t) or t

    def _letters(self, t: str) -> str | None:
        if t in self.words:
            return t
        if re.search(r"(.)\1\1", t) and (w := self._whole(list(t))) is not None:
            return w
        return self.swapped.get(t)

    def _whole(self, some: list[str]) -> str | None:
        """The word that all characters give; some: the letters that each may stand for."""
        end, w = self.forms.longest(some, 0, self.forms.runs(some))
        return w if end == len(some) else None

    def fold(self, text: str) -> str:
        """The document as folded words with a blank around each; remarks end with the word \\x00."""
        t = spread(plain(text)).replace("_", " ")
        foreign = not t.isascii() and len(re.findall("[а-яё]", t)) * 3 > len(re.findall(r"[^\W\d_]", t))
        known, look = self.known[foreign].get, self.look
        s = f" {' '.join([known(w) or look(w, foreign) for w in WORDS.findall(t)])} "
        return SPELT.sub(lambda m: f" {' '.join(self._joined(m[0].split()))} ", s) if SPELT.search(s) else s

    def _joined(self, letters: list[str]) -> list[str]:
        """Single letters in a row, joined where they spell a word of the lexicon."""
        out, i, n, runs = [], 0, len(letters), self.forms.runs(letters)
        while i < n:
            end, w = self.forms.longest(letters, i, runs)
            if w is not None and end - i > 2:
                out.append(w)
                i = end
            else:
                out.append(letters[i])
                i += 1
        return out

    def hits(self, folded: str) -> list[tuple[int, int, str, float]]:
        """(start, stop, term, weight) in folded words; of cues alone there are none."""
        found = [(end - len(t) - 1, end - 1, t, w) for end, (t, w) in self.automaton.iter(folded)]
        return found if any(w > 0 and t not in self.cues for _, _, t, w in found) else []

    def weigh(self, remark: str, hits: list[tuple[int, int, str, float]]) -> float:
        """The largest weight of WIDTH words in a row: distinct terms, the longest where they overlap, none inside an exception."""
        used: list[tuple[int, int, str, float]] = []
        taken = np.zeros(len(remark) + 1, bool)
        for lo, hi, t, w in sorted(hits, key=lambda h: (h[0] - h[1], h[3] != 0.0, h[0])):
            if not taken[lo + 1 : hi].any():
                taken[lo + 1 : hi] = True
                if w:
                    used.append((lo, hi, t, w))
        if not any(w > 0 and t not in self.cues for _, _, t, w in used):
            return 0.0
        used.sort()
        blanks = np.cumsum(np.frombuffer(remark.encode("utf-32-le"), np.uint32) == 32)
        place = [int(blanks[lo]) for lo, *_ in used]
        best, stop = 0.0, 0
        terms: dict[str, list] = {}  # of the words in view: weight and how often
        for i, (_, _, t, w) in enumerate(used):
            while stop < len(used) and place[stop] < place[i] + WIDTH:
                x = terms.setdefault(used[stop][2], [used[stop][3], 0])
                x[1] += 1
                stop += 1
            cues = sorted((w for t, (w, _) in terms.items() if t in self.cues), reverse=True)[:2]
            words = [w for t, (w, _) in terms.items() if t not in self.cues]
            if max(words, default=0.0) > 0:
                best = max(best, sum(words) + sum(c / (k + 1) for k, c in enumerate(cues)))
            terms[t][1] -= 1
            if not terms[t][1]:
                del terms[t]
        return best * CURT if blanks[-1] <= 3 else best  # a blank on either side


#: A word, a sentence end or a line end of plain text.
WORDS = re.compile(r"(?:[.?](?=[\s\"')]|$)|(?<!!)!{1,2}(?=\s|$)|[\n\r。！？])+|[^\W_][\w@$*+|€£¡]*(?:!+[\w@$*]+)*|[@$*][\w@$*!]+")
END = re.compile(r"[.?!\n\r。！？]+")
SPELT = re.compile(r"(?: \w(?= )){3,} ")

#: Frequent words that no obfuscation is resolved to.
COMMON = frozenset("you your he she is a an the and in of to it like what such must be want me do not was get on see with that our whole team this go learn read already knows group for up out them him her body back all by hands off near why are even paid will lips room".split())


def plain(text: str) -> str:
    """Compatibility forms, accents, invisible characters and case folded."""
    t = html.unescape(text) if "&" in text else text
    if t.isascii():
        return t.casefold()
    t = unicodedata.normalize("NFKD", t)
    return "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Cf", "Me")).casefold()


def spread(t: str) -> str:
    """Ideographs as words of one character each."""
    return t if t.isascii() else re.sub(r"([㐀-鿿])", r" \1 ", t)


def score_text(lexicon: Lexicon, text: str | None) -> tuple[float, float]:
    """(score, worst): the weight for 100 words of remarks with any term but cues, and the heaviest remark's weight (of any WIDTH words)."""
    if not text:
        return 0.0, 0.0
    folded = lexicon.fold(text)
    hits = lexicon.hits(folded)
    if not hits:
        return 0.0, 0.0
    weights, lo = [], 0
    for remark in folded.split("\x00"):
        hi = lo + len(remark)
        own = []
        while hits and hits[0][0] < hi:
            a, b, t, w = hits.pop(0)
            own.append((a - lo, b - lo, t, w))
        if own:
            weights.append(lexicon.weigh(remark, own))
        lo = hi + 1
    n = folded.count(" ") - 1 - folded.count("\x00")
    return round(sum(weights) * 100 / max(n, 20), 6), round(max(weights, default=0.0), 6)


@lru_cache(1)
def shared_lexicon() -> Lexicon:
    """The default lexicon, made once by each worker."""
    return default_lexicon()


def content_scores(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, source, score, worst, is_abusive) of every document. Null, empty and blank texts score 0. Sources are trimmed
    and lower-cased, a missing one is null. Repeated rows give repeated rows; other columns are ignored."""
    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.nullif(F.lower(F.trim("source")), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared_lexicon()
        for b in batches:
            got = [score_text(lexicon, t) for t in b.column("text").to_pylist()]
            worst = [w for _, w in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array([s for s, _ in got], pa.float64()), pa.array(worst, pa.float64()), pa.array([w >= threshold for w in worst], pa.bool_())], names=["doc_id", "source", "score", "worst", "is_abusive"])

    return src.mapInArrow(run, "doc_id long, source string, score double, worst double, is_abusive boolean")


def source_rates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, n_documents, n_abusive, rate, mean_score) of every source."""
    return content_scores(documents, threshold).groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("is_abusive").cast("long")).alias("n_abusive"), F.avg(F.col("is_abusive").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
