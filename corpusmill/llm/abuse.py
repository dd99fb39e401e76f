"""Abusive, hateful or sexually explicit content, by weak supervision.

Method. Texts are folded (compatibility forms, case, invisible characters, look-alike letters), split into
sentences and words; disguised words (digits and symbols for letters, stretched, starred and spaced-out
ones) are revealed. Every word gets the classes it has in lexicons of several languages, and voters are
patterns over the classes of a sentence ("second person, at most three words, insult"), for and against.
A generative label model explains the votes: EM over the counts of all vote vectors of the corpus
estimates how often each voter speaks in each of the two classes and on which other voter its vote
depends (the tree of greatest conditional mutual information), so voters that say the same are not counted
twice. Its posteriors are the labels on which a linear classifier is trained: votes, words, character
n-grams inside words and word pairs. *Every* sentence of every document is scored by that classifier, and
a document's score is its worst sentence's.

Plan. Two passes over the whole texts. The first counts vote vectors, combined within each task, and keeps
of each vector the sentences of the smallest hashes; the second scores. The classifier is fitted on at most
``TRAIN_ROWS`` distinct sentences: each vector's share is settled from the counts before the is
collected, so the driver gets no more rows than that. Scores are the maximum over a document's sentences,
taken where the document lies.

Defined results: null, empty and blank texts score as a sentence without words does; repeated rows of a
document give one row; null sources are a source of their own in the rates; of sentences with the same score
the first is named.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.topn import top_n
from corpusmill.runtime import written

#: Distinct sentences the classifier is fitted on at most; at most so many of those of one vote vector, and of those without a vote.
TRAIN_ROWS, VECTOR_ROWS, SILENT_ROWS = 20_000, 500, 8_000
THRESHOLD = 0.5
HASHED = 1 << 17
#: Longer sentences are scored in windows of so many words, each half over the last.
WINDOW = 40

# --- lexicons: class of words -> words of several languages (fixed values) -------------------------

LEXICON = {
    "YOU": "you your yours yourself yourselves u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine deiner deinen deinem ihr euch eres sois tú ti usted ustedes vosotros sei você vc teu tua ты тебя тебе тобой твой твоя вы вас",
    "BE": "are re is be been being am was were es est sont êtes suis bist ist sind seid eres son sois sei è sono é são seja",
    "INSULT": "idiot idiots moron morons imbecile imbeciles cretin cretins halfwit halfwits dimwit dimwits nitwit nitwits dumbass dumbasses jackass jackasses ass prick pricks tosser tossers dunce dunces simpleton simpletons loser losers "
    "clown clowns coward cowards fool fools freak freaks creep creeps pig pigs swine scum lowlife lowlifes trash garbage filth maggot maggots worm worms parasite parasites vermin weirdo psycho liar crybaby "
    "abruti abrutis abrutie crétin crétins crétine imbécile imbéciles débile débiles raclure raclures ordure ordures bâtard bâtards con cons conne incapable incapables merde porc bouffon "
    "trottel trotteln penner versager schwein schweine sau dummkopf dummköpfe depp deppen missgeburt abschaum dreck drecksack idioten spinner arsch "
    "imbécil imbéciles idiota idiotas estúpido estúpida estúpidos cerdo cerda zorra capullo basura mierda inútil asqueroso payaso stupido cretino imbecille imbecil burro babaca otário "
    "идиот идиотка дурак дура дебил мразь урод тварь придурок козёл",
    "STRONG": "asshole assholes arsehole arseholes bastard bastards bitch bitches scumbag scumbags dipshit dipshits shithead shitheads dickhead dickheads dumbfuck dumbfucks cunt cunts twat twats wanker wankers whore whores slut sluts retard retards fucker fuckers motherfucker motherfuckers douchebag douchebags faggot faggots "
    "connard connards connasse salaud salauds salope salopes enculé enculés pute putes arschloch arschlöcher wichser hurensohn fotze schlampe vollidiot vollidioten drecksau mistkerl "
    "gilipollas cabrón cabron cabrones pendejo pendejos puta putas puto maricón hijueputa stronzo stronza coglione troia puttana сука суки блядь ублюдок пидор",
    "ADJ": "stupid dumb useless worthless pathetic disgusting filthy brainless braindead ugly miserable spineless clueless idiotic moronic fucking rotten vile repulsive retarded lazy fat stinking loathsome despicable "
    "stupide stupides inutile minable sale sales dégueulasse pauvre grosse gros fini finie dumm dumme dummer mieses miese mieser elend elender erbärmlich erbärmlicher erbärmliche widerlich hässlich hässlicher nutzlos estúpido estúpida asqueroso asquerosa inútil feo fea maldito maldita тупой тупая",
    "LOATHE": "hate hates hated despise despises loathe loathes detest detests disgust disgusts déteste détestent méprise hasse hasst hassen verachten verachtet odia odian odio desprecia soporta aguanta",
    "NOBODY": "nobody noone everybody everyone personne keiner niemand jeder alle nadie todos",
    "WANT": "want wants like likes love loves need needs miss misses respects respect quiere quieren ama will braucht mag veut aime",
    "KILL": "kill killed kills hang hanged burn burned burnt shoot shot beat beaten whip whipped flogged stab stabbed bleed strangle strangled drown drowned starve starved murder murdered choke gassed gas lynched slaughter slaughtered crush smash break cut throat tuer tué crever brûler égorger umbringen töten erschossen erschießen vergast verprügelt matar matarlos matarte romper muerte ammazzare ammazzo убью убить",
    "PUNISH": "beaten whipped flogged hanged shot stabbed burned starved gassed lynched locked caged castrated eingesperrt erschossen pendus enfermés fusilados",
    "DIE": "die dies dead death crève crever meurs mourir verreck verrecke sterben stirb tot mueras muera muérete muere morir muori сдохни умри",
    "BODY": "face throat neck skull head teeth fingers finger hands hand legs leg arms bones nose eyes gueule gesicht knochen hals cara huesos cuello",
    "EXPEL": "deport deported exterminate exterminated eradicate eradicated eliminate eliminated expelled expel driven gassed gas hunted hunt wiped wipe rid cleanse purged chasser éliminer exterminer expulser renvoyer renvoie virer ausgerottet ausrotten vertrieben vertreiben vernichtet vernichten abgeschoben abschieben raus weg matarlos echarlos eliminarlos expulsarlos exterminarlos deportarlos",
    "MODAL": "should must ought need have will deserve deserves deserved shall faut doivent doit mérite méritent gehört gehören müssen muss sollte sollten hay deben debe debería merece merecen",
    "SUBHUMAN": "rats rat vermin parasites parasite cockroaches cockroach animals subhuman subhumans filth scum disease plague cancer savages insects leeches leech pest pests apes monkeys dogs "
    "vermine cafards cafard racaille ungeziefer abschaum ratten parasiten untermenschen dreck gesindel ratas basura escoria cucarachas plaga parásitos",
    "CRIMINAL": "criminals thieves liars rapists murderers terrorists cheats voleurs criminels menteurs violeurs verbrecher diebe lügner ladrones criminales mentirosos",
    "PEOPLE": "they them their people every all everyone us we those these ones folk refugees immigrants migrants foreigners women men gays jews muslims blacks les ils ces tous étrangers die diese alle ausländer flüchtlinge los las esos estos todos inmigrantes",
    "DENY": "not don doesn never cannot ne no nicht nunca nie ni",
    "DESERVE": "deserve deserves trust mérite méritent verdienen merecen",
    "KEEP": "keep out away kick throw get",
    "OUR": "our unser unsere nuestro nuestra nos notre",
    "ESSENCE": "birth blood nature breed race",
    "LIFE": "live vote marry work breathe exist breed stay among",
    "WITHOUT": "without sans ohne sin",
    "PLACE": "place world country town city planet",
    "SHUT": "shut halt ferme fermez cierra chiudi cala fermati halts hold",
    "MOUTH": "up mouth trap gueule fresse maul klappe schnauze boca bocca pico hocico",
    "GO": "go va vete vai geh fahr váyanse get drop crawl piss fuck screw fick",
    "CURSE": "fuck screw damn piss sod fick fickt chinga chíngate foda nique",
    "AWAY": "hell lost dead off diable enfer infierno carajo diablo hölle teufel inferno foutre merde fottere foder mierda back dich",
    "BEGONE": "verpiss cállate callate vaffanculo lárgate dégage casse ta заткнись vete fottiti cállense stfu gtfo kys",
    "DEATHWISH": "hope wish hopefully espère hoffe hoffentlich ojalá espero",
    "SHAME": "ashamed shame shameful disgrace embarrassment honte schäm schäme schämen schande vergüenza vergogna vergonha",
    "FAVOUR": "favour favor",
    "VANISH": "disappear vanish jump leave quit go stop",
    "I": "i we ich wir je nous yo ll someone somebody te",
    "WILL": "will ll gonna going vais allons werde werden bring bringe voy vamos mach",
    "PAY": "pay regret suffer hurt cry beg bleed sorry",
    "PORN": "porn porno pornos porns pornography pornographie pornografía xxx nudes horny milf orgy orgies blowjob blowjobs gangbang titten порно секс sextape sexting hentai",
    "NAKED": "naked nude nackt nackte nackten nackig desnuda desnudas desnudo nue nues nuda nua голая",
    "SEX": "sex fuck fucks fucked fucking pussy cock cocks dick dicks tits boobs panties orgasm orgasms erotic hardcore masturbate masturbating masturbated clit cum slutty nipples bra ficken fickt gefickt baise baiser bite chatte sexe follar folla polla coño chupó chupa corrió muschi schwanz leckte suçait scopare cazzo moaned moaning grunted gémissant stripped undressed orgasmus",
    "ACT": "lick licked licking suck sucked sucking rode riding stripped sucks kissed touched squeezed grabbed spread moaned grunted came leckte chupó suçait",
    "MEDIA": "video videos clip clips movie movies film films pic pics picture pictures photo photos tape tapes site sites cam cams vidéo vidéos filme bilder fotos vídeos",
    "LURE": "free hot amateur click watch send show wild rough explicit uncensored censure zensur censura teen teens singles hottest kostenlose gratis harte wilde senza show see want",
    "HEOTHER": "he she him her his hers they each il elle er sie él ella",
    "LIKE": "like comme wie como",
    "OATH": "damn hell shit crap merde mierda scheiße scheisse joder bloody fuck fucking putain verdammt coño cazzo stupid dumb idiotic stupidly damned",
    "META": "reviewer reviewers moderator moderators moderatoren word words wordlist list listed quoted quoting quotes quote term terms abusive filter filtered filters flagged label labels labelled classifier policy describes described description called calls mark marks mot mots liste wort wörter palabra palabras slur slurs propaganda article chapter review spam",
    "TECH": "process processes child parent replica replicas slave master heartbeat job jobs thread threads signal flag daemon zombie orphan orphans heap collected collection collector collect branch query queries index cache caches record records column field fields table code coded file files bug bugs build server parser input deploy latency release attack surface column stub limit rate",
    "HEALTH": "cancer hormone hormones medical clinic clinical breast patient patients drug drugs health contraception education reproductive demographic survey sightings species laboratory labor mole wild animal screening treatment sample",
    "POLITE": "please thank thanks kindly merci danke gracias welcome bitte por favor",
}
SLURS_ZH = "傻逼 白痴 蠢货 混蛋 王八蛋 去死 畜生 贱人 滚蛋 垃圾".split()
CLASSES = list(LEXICON)
_BIT = {c: 1 << k for k, c in enumerate(CLASSES)}
#: Classes whose words are worth hiding.
_HIDEABLE = ("STRONG", "INSULT", "ADJ", "PORN", "NAKED", "SEX", "KILL", "SUBHUMAN")


@lru_cache(maxsize=1)
def _masks() -> dict[str, int]:
    """Word -> the classes it has."""
    out: dict[str, int] = {}
    for c, words in LEXICON.items():
        for w in words.split():
            out[w] = out.get(w, 0) | _BIT[c]
    return out


#: Left behind a word that was hidden: a sign of its own, since people rarely hide harmless words.
_SIGN = "\ue001"

# --- folding -------------------------------------------------------------------------------------

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]")
_LOOKALIKE = str.maketrans("асеорхуіјѕһԁԛԝвкмнтгп" + "αορνκιετυχ", "aceopxyijshdqwbkmhtrn" + "aopvkietux")
_LEET = str.maketrans("4310$5@7!", "aeiossati")
_MIXED = re.compile(r"\b(?:[a-z]+[Ͱ-ӿԀ-ԯ]|[Ͱ-ӿԀ-ԯ]+[a-z])\w*")
_FOREIGN = re.compile("[Ͱ-ԯ]")
_CODED = re.compile(r"(?<![\w@$!])(?:[a-z]+[0-9@$!]+|[0-9@$!]+[a-z]+)[a-z0-9@$!]*(?![\w@$])")
_SPACED = re.compile(r"(?<!\w)\w(?:[ .\-_*]{1,2}\w){2,}(?!\w)")
_STARRED = re.compile(r"(?<![\w*])[a-z][a-z*]*\*+[a-z*]*[a-z](?![\w*])")
_STRETCHED = re.compile(r"(?<!\w)\w*(\w)\1\w*(?!\w)")
_RUN = re.compile(r"(.)\1+")


def _squeeze(word: str) -> str:
    return _RUN.sub(r"\1", word)


@lru_cache(maxsize=1)
def _known() -> tuple[frozenset[str], dict[str, str], dict[int, list[str]]]:
    """All words that a disguise may hide, by squeezed form, and by length for starred ones (of several, the first is meant)."""
    listed = list(dict.fromkeys(w for c in _HIDEABLE for w in LEXICON[c].split() if len(w) > 2)) + ["shit", "hell", "crap", "you", "your"]
    by_length: dict[int, list[str]] = {}
    for w in [*LEXICON["ADJ"].split(), *listed]:
        by_length.setdefault(len(w), []).append(w)
    return frozenset(listed), {_squeeze(w): w for w in sorted(listed, reverse=True)}, by_length


def _revealed(word: str) -> str | None:
    words, squeezed, _ = _known()
    return word if word in words else squeezed.get(_squeeze(word))


def _decode(m: re.Match) -> str:
    for table in (_LEET, str.maketrans("4310$5@7!", "aelossatl")):
        found = _revealed(m.group().translate(table).strip("!"))
        if found:
            return f" {found} {_SIGN}"
    return m.group()


def _join(m: re.Match) -> str:
    letters = re.sub(r"[ .\-_*]", "", m.group())
    for first in range(3):  # a word of one letter may stand before or after
        for last in range(len(letters), max(first + 3, len(letters) - 3), -1):
            found = _revealed(letters[first:last])
            if found:
                return " ".join([*letters[:first], found, *letters[last:]]) + f" {_SIGN}"
    return m.group()


def _unstar(m: re.Match) -> str:
    token = m.group()
    if token.strip("*") == "" or "*" not in token.strip("*"):
        return token
    shape = re.compile(token.replace("*", "."))
    found = next((w for w in _known()[2].get(len(token), ()) if shape.fullmatch(w)), None)
    return f"{found} {_SIGN}" if found else token


def _unstretch(m: re.Match) -> str:
    words, squeezed, _ = _known()
    word = m.group()
    if word in words:
        return word
    found = squeezed.get(_squeeze(word))
    return f"{found} {_SIGN}" if found and len(word) > len(found) and len(found) > 3 else word


def _unmix(m: re.Match) -> str:
    plain = m.group().translate(_LOOKALIKE)
    return plain + _SIGN if _revealed(plain) else plain


def fold(text: str) -> str:
    """Lower case, without disguises that concern characters."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = (_INVISIBLE.sub("", text) if _INVISIBLE.search(text) else text).lower()
        text = _MIXED.sub(_unmix, text) if _FOREIGN.search(text) else text
        return text
    return text.lower()


def reveal(sentence: str) -> str:
    """A folded sentence without disguises that concern words."""
    s = _CODED.sub(_decode, sentence)
    if "*" in s:
        s = _STARRED.sub(_unstar, s)
    s = _STRETCHED.sub(_unstretch, _SPACED.sub(_join, s))
    return " ".join(s.replace(_SIGN, " ").split()) + " " + _SIGN if _SIGN in s else s



# --- words and classes ---------------------------------------------------------------------------

_WORD = re.compile(r"[^\W_][\w@$]*(?:[!*]+[\w@$]+)*|[@$][\w@$]*\w|" + _SIGN)
_CJK = re.compile("[一-鿿]")
#: A line's end, and what ends a sentence where it ends or stands alone; in codes, where one ends.
_LINE, _END = "\ue002", "\n"
_STOP = re.compile(r"[.!?…][\"'”’)\]]*$|[。！？]|" + _LINE)
_BLOCK, _INLINE = re.compile(r"</?(?:p|li|[uo]l|br|hr|t[dhr]|table|h[1-6]|div|body|html|pre|title)\b[^<>]*>"), re.compile(r"</?[a-z][^<>]*>")
_PLAIN, _LETTER = ".", ","  # codes of a word without a class, and of a single letter or digit
_FIRST = 0xE100


class _Memo(dict):
    """A function's results, forgotten when there are too many."""

    def __init__(self, of, limit: int = 300_000):
        super().__init__()
        self.of, self.limit = of, limit

    def __missing__(self, key):
        if len(self) > self.limit:
            self.clear()
        found = self[key] = self.of(key)
        return found


def _read(token: str) -> tuple[str, str]:
    """Codes and meaning of what stands between two spaces: a code per word in it, and one more where a sentence ends."""
    codes, words = [], []
    for word in _WORD.findall(token if token.isalpha() else reveal(token)):
        if word == _SIGN:
            codes.append(_char(_HIDDEN))
            continue
        plain = word.strip("_")
        masks = _masks()
        if token.isalpha() and plain not in masks:
            shown = reveal(plain)
            if _SIGN in shown:
                plain = shown.split()[0]
                codes.append(_char(_HIDDEN))
        mask = masks.get(plain, 0)
        if _CJK.search(plain):
            mask |= (_BIT["YOU"] if "你" in plain or "您" in plain else 0) | (_BIT["STRONG"] if any(w in plain for w in SLURS_ZH) else 0)
        codes.append(_char(mask) if mask else _LETTER if len(plain) == 1 else _PLAIN)
        words.append("0" if plain.isdigit() else plain)
    return "".join(codes) + _END * bool(_STOP.search(token)), "+".join(words)


_tokens = _Memo(_read)
_codes = _Memo(lambda token: _tokens[token][0])
_HIDDEN = 1 << len(CLASSES)


def _char(mask: int) -> str:
    """The code of a set of classes, one character."""
    return chr(_FIRST + _numbers()[mask])


@lru_cache(maxsize=1)
def _numbers() -> dict[int, int]:
    """Sets of classes that words have, each with a number."""
    sets = {*_masks().values(), _BIT["YOU"] | _BIT["STRONG"], _HIDDEN}
    return {m: k for k, m in enumerate(sorted(sets))}


def _set(*names: str) -> str:
    """The codes of words that have one of the classes, as a character class."""
    bits = sum(_HIDDEN if n == "HIDDEN" else _BIT[n] for n in names)
    return "[" + "".join(chr(_FIRST + k) for m, k in _numbers().items() if m & bits) + "]"


#: Three single letters in a row may be a word that is spaced out.
_LETTERS = re.compile(rf"(?:{_LETTER}|{_set('YOU', 'I')}){{3}}")


def meant(tokens: list[str]) -> list[str]:
    """The words of a sentence without disguises and punctuation."""
    return [w for t in tokens if (w := _tokens[t][1])]


def sentences(text: str):
    """``(codes, tokens)`` of all sentences of a text; long ones in windows of WINDOW tokens, each half over the last."""
    folded = fold(text)
    if "<" in folded:
        folded = _INLINE.sub(" ", _BLOCK.sub("\n", folded))
    if "\n" in folded or "\r" in folded:
        folded = folded.replace("\r", "\n").replace("\n", f" {_LINE} ")
    tokens = folded.split()
    codes = [*map(_codes.__getitem__, tokens)]
    spaced = _LETTERS.search("".join(codes))
    start = 0
    for end in [k for k, c in enumerate(codes, 1) if c[-1:] == _END] + [len(tokens)]:
        joined, own, parts = "".join(codes[start:end]), tokens[start:end], codes[start:end]
        start = end
        if len(joined) < 2 and joined in ("", _END):
            continue
        if spaced and _LETTERS.search(joined):
            shown = reveal(" ".join(own))
            if _SIGN in shown:
                own = shown.split()
                parts = [*map(_codes.__getitem__, own)]
                joined = "".join(parts)
        if len(own) <= WINDOW * 3 // 2:
            yield joined, own
        else:
            for k in range(0, len(own) - WINDOW // 2, WINDOW // 2):
                yield "".join(parts[k : k + WINDOW]), own[k : k + WINDOW]


# --- voters --------------------------------------------------------------------------------------


def _pattern(template: str) -> re.Pattern:
    """``<A|B>``: a word of class A or B; ``~n``: at most n words between."""
    s = re.sub(r"<([A-Z|]+)>", lambda m: _set(*m.group(1).split("|")), template)
    return re.compile(re.sub(r"~(\d)", r".{0,\1}?", s).replace("#", ".*"))


_BAD = "<INSULT|STRONG>"
#: (name, opinion, pattern over classes): +1 abusive, -1 harmless. The first two are the plainest.
VOTERS: list[tuple[str, int, re.Pattern]] = [
    (name, opinion, _pattern(template))
    for name, opinion, template in (
        ("insult_you", 1, rf"<YOU>~3{_BAD}|{_BAD}~2<YOU>"),
        ("adjective_you", 1, rf"<YOU><BE>?~2<ADJ>|<BE><YOU>~2<ADJ>"),
        ("adjective_insult", 1, rf"<ADJ>~1{_BAD}|{_BAD}<ADJ>"),
        ("insult_strong", 1, "<STRONG>"),
        ("loathed", 1, "<LOATHE>~1<YOU>|<YOU>~1<LOATHE>|<NOBODY>~2<WANT>~2<YOU>|<NOBODY>~1<YOU>~1<WANT|LOATHE>|<YOU><LOATHE>"),
        ("dismissal", 1, "<SHUT>~1<MOUTH>|<GO>~2<AWAY>~4<YOU|INSULT|STRONG>|<BEGONE>|<YOU>~1<GO>~2<AWAY>|<CURSE><YOU>"),
        ("shamed", 1, "<YOU>~4<SHAME>|<SHAME>~3<YOU>|<FAVOUR>~2<VANISH|DIE|KILL|SHUT>"),
        ("scorned", 1, "<PEOPLE|HEOTHER>~2<BE>~2<ADJ|INSULT|STRONG>"),
        ("death_wish", 1, "<DEATHWISH>~3<DIE|KILL>|<KILL><YOU>|<YOU>~2<MODAL>~2<DIE|KILL|PUNISH>"),
        ("threat", 1, "<I>~2<WILL>~3<KILL|PAY>|<I>~2<WILL>~2<YOU>~3<KILL|PAY>|<KILL>~2<YOU>~1<BODY>|<I>~2<YOU>~2<KILL>|<MODAL>~1<KILL>~1<YOU>"),
        ("punish", 1, "<PEOPLE|YOU>~2<MODAL>~2<PUNISH>|<MODAL>~1<BE>~1<PUNISH>|<INSULT|STRONG>~3<PUNISH>"),
        ("subhuman", 1, "<BE>~2<SUBHUMAN>|<LIKE>~3<SUBHUMAN>|<PEOPLE>~3<SUBHUMAN>"),
        ("expel", 1, "<MODAL>~3<EXPEL>#<PEOPLE>|<PEOPLE|SUBHUMAN|CRIMINAL>#<MODAL>~3<EXPEL>|<EXPEL>~2<PEOPLE>|<MODAL>~1<BE>~1<EXPEL>"),
        ("denied", 1, "<DENY>~1<DESERVE>~4<LIFE|PEOPLE>|<KEEP>~2<KEEP>~2<OUR>|<PLACE>~1<WITHOUT>"),
        ("criminal", 1, "<BE>~1<CRIMINAL>|<CRIMINAL>~1<ESSENCE>|<DENY><DESERVE>"),
        ("explicit", 1, "<PORN|SEX|NAKED>~8<PORN|SEX|ACT>|<ACT>~8<PORN|SEX|NAKED>|<NAKED>~8<SEX>"),
        ("explicit_act", 1, "<HEOTHER>~4<SEX>~6|<ACT>~2<YOU|HEOTHER>~2<SEX|BODY|INSULT>|<HEOTHER>~2<ACT>~1<HEOTHER>"),
        ("explicit_offer", 1, "<LURE>~3<PORN|SEX>|<PORN|NAKED>~2<MEDIA>|<MEDIA>~1<PORN|NAKED>|<PORN>~1<LURE|WITHOUT>"),
        ("explicit_word", 1, "<PORN>"),
        ("hidden", 1, "<HIDDEN>"),
        ("meta", -1, "<META>"),
        ("technical", -1, "<TECH>#<TECH>|<KILL|DIE|INSULT|ADJ|STRONG|SUBHUMAN|SEX>~1<TECH>|<TECH>~1<KILL|DIE|INSULT|SEX>"),
        ("health", -1, "<HEALTH>"),
        ("oath", -1, "<OATH>"),
        ("polite", -1, "<POLITE>"),
    )
]
NAMES = [v[0] for v in VOTERS]
OPINIONS = np.array([v[1] for v in VOTERS])
#: Without a word of one of these there is nothing to vote on.
_HOT = re.compile(_set("INSULT", "STRONG", "ADJ", "LOATHE", "NOBODY", "SHAME", "FAVOUR", "SHUT", "AWAY", "CURSE", "BEGONE", "DEATHWISH", "KILL", "DIE", "PAY", "PUNISH", "SUBHUMAN", "EXPEL", "DESERVE", "OUR", "PLACE", "CRIMINAL", "PORN", "NAKED", "SEX", "ACT", "OATH", "HIDDEN"))
_ADDRESSED = re.compile(_set("YOU", "PEOPLE", "HEOTHER"))
_OATH = NAMES.index("oath")


def votes(codes: str) -> int:
    """The voters that speak up, as the bits of a number. An oath is harmless only if it concerns nobody."""
    if not _HOT.search(codes):
        return 0
    out = 0
    for k, (_, _, p) in enumerate(VOTERS):
        if p.search(codes):
            out |= 1 << k
    if out >> _OATH & 1 and _ADDRESSED.search(codes):
        out ^= 1 << _OATH
    return out


# --- label model ---------------------------------------------------------------------------------


class LabelModel:
    """Two classes; a voter speaks with a probability that depends on the class and on one other voter.

    That the voters are better than chance is all that is assumed: EM starts from their plain majority,
    which also keeps a part (``hold``) of the say, and no vote for abuse lowers a posterior. A sentence on
    which no voter for abuse speaks is harmless.
    """

    def __init__(self, vectors: np.ndarray, counts: np.ndarray, rounds: int = 60, prior: float = 0.02, smooth: float = 1.0, hold: float = 0.3):
        b, n = self._bits(vectors), counts.astype(float)
        self.prior, voters = prior, len(VOTERS)
        for_it = b[:, OPINIONS > 0].sum(1)
        start = np.where(for_it > b[:, OPINIONS < 0].sum(1), 0.95, 0.05) * (for_it > 0)
        q, self.parent = start, np.full(voters, -1)
        for step in range(rounds):
            held = (1 - hold) * q + hold * start if step else start
            w = np.stack([(1 - held) * n, held * n])
            if step % 10 == 1:
                self.parent = self._tree(b, w)
            self.p = self._rates(b, w, smooth)
            self.prior = float(np.clip(w[1].sum() / n.sum(), 1e-5, 0.5))
            q = self.posterior(vectors)
        self.correlated = self.correlation(b, n, q)
        own = np.arange(voters)
        #: Share of a voter's evidence that is its own.
        self.weights = np.where(self.parent < 0, 1.0, 1 - np.abs(self.correlated[own, self.parent]))

    @staticmethod
    def _bits(vectors) -> np.ndarray:
        return ((np.asarray(vectors)[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)

    @staticmethod
    def correlation(b: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Pairwise correlation of speaking up within the abusive class."""
        w = q * n / max((q * n).sum(), 1e-9)
        mean = w @ b
        cov = (b * w[:, None]).T @ b - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        return np.clip(cov / np.outer(sd, sd), -1, 1)

    @staticmethod
    def _tree(b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Each voter's parent in the forest of greatest conditional mutual information; -1 for none (chance explains the rest)."""
        total, info = w.sum(), 0.0
        for wy in w:
            n = max(wy.sum(), 1e-9)
            one = np.clip(wy @ b / n, 1e-9, 1 - 1e-9)
            both = np.clip((b * wy[:, None]).T @ b / n, 1e-12, 1)
            for pair, chance in (
                (both, np.outer(one, one)), (one[:, None] - both, np.outer(one, 1 - one)), (one[None] - both, np.outer(1 - one, one)), (1 - one[:, None] - one[None] + both, np.outer(1 - one, 1 - one)),
            ):
                pair = np.clip(pair, 1e-12, 1)
                info = info + n / total * pair * np.log(pair / chance)
        parent, inside = np.full(len(VOTERS), -1), {0}
        while len(inside) < len(VOTERS):
            rest = [k for k in range(len(VOTERS)) if k not in inside]
            value, child, at = max((info[a, c], c, a) for c in rest for a in inside)
            if 2 * total * value > 20:
                parent[child] = at
            inside.add(child)
        return parent

    def _rates(self, b: np.ndarray, w: np.ndarray, smooth: float) -> np.ndarray:
        """``p[class, state of the parent, voter]``: how often the voter speaks; few cases lean on the rate over both states."""
        out = np.zeros((2, 2, len(VOTERS)))
        above = np.where(self.parent[None] >= 0, b[:, self.parent], 0.0)
        for y, wy in enumerate(w):
            plain = (wy @ b + smooth * (0.2 if y else 0.002)) / (wy.sum() + smooth)
            for state in (0, 1):
                there = wy[:, None] * (above if state else 1 - above)
                out[y, state] = ((there * b).sum(0) + 3 * smooth * plain) / (there.sum(0) + 3 * smooth)
        return np.clip(out, 1e-6, 1 - 1e-6)

    def posterior(self, vectors: np.ndarray) -> np.ndarray:
        b = self._bits(vectors)
        above = np.where(self.parent[None] >= 0, b[:, self.parent], 0.0).astype(int)
        voter = np.arange(len(VOTERS))
        p0, p1 = self.p[0][above, voter], self.p[1][above, voter]
        evidence = np.where(b > 0, np.log(p1 / p0), 0.0)  # who abstains says nothing
        evidence = np.where(OPINIONS > 0, np.maximum(evidence, 0), np.minimum(evidence, 0))
        logit = np.log(self.prior / (1 - self.prior)) + evidence.sum(1)
        return np.where(b[:, OPINIONS > 0].any(1), 1 / (1 + np.exp(-np.clip(logit, -30, 30))), 1e-3)


# --- classifier ----------------------------------------------------------------------------------


def _slot(gram: str) -> int:
    return crc32(gram.encode("utf-8", "surrogatepass")) % HASHED


def grams(word: str) -> list[int]:
    """Slots of the character n-grams of three to five of a word, its edges marked."""
    edged = f"<{word}>"
    return [_slot(edged[k : k + n]) for n in (3, 4, 5) for k in range(len(edged) - n + 1)]


class Classifier:
    """Logistic regression on soft labels over votes, words (with their n-grams) and word pairs.

    A word counts as its own weight plus the mean of its n-grams'; words and pairs of a sentence share
    weight 1 by the root of their number; ``l2`` is the penalty of votes, n-grams, words and pairs. Words and pairs of the sample have weights of their own, other
    words those of their n-grams. A word's part does not depend on the sentence, so scoring one adds up
    remembered numbers.
    """

    def __init__(self, rows: list[tuple[list[str], int]], labels: np.ndarray, rounds: int = 400, l2: tuple[float, float, float] = (1e-6, 1e-4, 1e-3), rate: float = 0.1):
        self.of_vote, self.of_gram, self.b = np.zeros(len(VOTERS)), np.zeros(HASHED, np.float32), -6.9
        if not rows:
            return self._ready({})
        units: dict = {}  # distinct words and pairs
        row, unit = [], []
        for r, (words, _) in enumerate(rows):
            own = [*words, *zip(words, words[1:])]
            row += [r] * len(own)
            unit += [units.setdefault(u, len(units)) for u in own]
        row, unit = np.array(row, np.int64), np.array(unit, np.int64)
        slots = [grams(u) if isinstance(u, str) else [] for u in units]
        of = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
        slot = np.fromiter((x for s in slots for x in s), np.int64)
        share = np.repeat([1 / max(1, len(s)) for s in slots], [len(s) for s in slots])
        value = 1 / np.sqrt(np.bincount(row, minlength=len(rows)).clip(1)[row])
        bits = LabelModel._bits(np.array([v for _, v in rows], np.int64))
        pos = labels.sum()  # both classes weigh the same
        weight = np.where(labels > 0.5, 0.5 / max(pos, 1), 0.5 / max(len(labels) - pos, 1))
        sizes = np.cumsum([len(VOTERS), HASHED, len(units)])
        w, b = np.zeros(sizes[-1] + 1), sizes
        m, s, penalty = np.zeros_like(w), np.zeros_like(w), np.repeat([*l2, 0.0], [len(VOTERS), HASHED, len(units), 1])
        for step in range(1, rounds + 1):
            votes_w, gram_w, unit_w = np.split(w[:-1], b[:2])
            per_unit = unit_w + np.bincount(of, gram_w[slot] * share, len(slots))
            z = np.bincount(row, per_unit[unit] * value, len(rows)) + bits @ votes_w + w[-1]
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weight
            back = np.bincount(unit, g[row] * value, len(slots))
            gw = np.concatenate([g @ bits, np.bincount(slot, back[of] * share, HASHED), back, [g.sum()]]) + penalty * w
            m, s = 0.9 * m + 0.1 * gw, 0.98 * s + 0.02 * gw**2
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-7)
        self.of_vote, of_gram, of_unit = np.split(w[:-1], b[:2])
        self.of_gram, self.b = of_gram.astype(np.float32), float(w[-1])
        self._ready({u: float(x) for u, x in zip(units, of_unit) if abs(x) > 1e-3})

    def _ready(self, of_unit: dict) -> None:
        """Words are numbered from 1, pairs are two numbers in one; arrays, so that little is done where the model arrives."""
        listed = sorted({w for u in of_unit for w in ((u,) if isinstance(u, str) else u)})
        self.listed, self.of_word = listed, np.array([of_unit.get(w, 0.0) for w in listed], np.float32)
        numbers = {w: k for k, w in enumerate(listed, 1)}
        pairs = sorted((numbers[u[0]] << 32 | numbers[u[1]], x) for u, x in of_unit.items() if not isinstance(u, str))
        self.pair_keys, self.pair_weights = (np.array(c, t) for c, t in zip(zip(*pairs, (1 << 62, 0.0)), (np.int64, np.float32)))
        self._remember()

    def _remember(self) -> None:
        numbers = {w: k for k, w in enumerate(self.listed, 1)}
        #: Number of a word of the sample, 0 of another one, -1 where a token has no word.
        self.numbers = _Memo(lambda token: numbers.get(w, 0) if (w := _tokens[token][1]) else -1)
        by_word = _Memo(lambda word: (float(self.of_word[k - 1]) if (k := numbers.get(word)) else 0.0) + (float(self.of_gram[own].mean()) if (own := grams(word)) else 0.0))
        self.words, self.bits = _Memo(lambda token: by_word[w] if (w := _tokens[token][1]) else 0.0), _Memo(self._votes)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("of_vote", "of_gram", "listed", "of_word", "pair_keys", "pair_weights", "b")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._remember()

    def _votes(self, vector: int) -> float:
        return float(sum(self.of_vote[k] for k in range(len(VOTERS)) if vector >> k & 1)) + self.b

    def scores(self, tokens: list[str], lengths: list[int], vectors: list[int]) -> np.ndarray:
        """Scores of sentences that lie one behind the other in ``tokens``."""
        number = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
        weight = np.fromiter(map(self.words.__getitem__, tokens), np.float64, len(tokens))
        of = np.repeat(np.arange(len(lengths)), lengths)
        if (number < 0).any():
            kept = number >= 0
            number, weight, of = number[kept], weight[kept], of[kept]
        total = np.bincount(of, weight, len(lengths))
        first = np.flatnonzero((of[1:] == of[:-1]) & (number[1:] > 0) & (number[:-1] > 0))
        key = number[first] << 32 | number[first + 1]
        at = np.searchsorted(self.pair_keys, key)
        hit = self.pair_keys[at] == key
        total += np.bincount(of[first[hit]], self.pair_weights[at[hit]], len(lengths))
        units = (2 * np.bincount(of, minlength=len(lengths)) - 1).clip(1)
        z = total / np.sqrt(units) + np.fromiter(map(self.bits.__getitem__, vectors), np.float64, len(lengths))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, tokens: list[str], vector: int) -> float:
        return float(self.scores(tokens, [len(tokens)], [vector])[0])


# --- over Spark ----------------------------------------------------------------------------------

_SAMPLE = "votes bigint, n bigint, sentence string, hash bigint"


def vote_table(documents: DataFrame, text: str) -> DataFrame:
    """``(votes, n, sentence, hash)``: counts of the vote vectors of all sentences (sentence null), and of each
    vector the sentences with the smallest hashes, as many as the sample can need (n null)."""

    def run(batches):
        counts: dict[int, int] = {}
        kept: dict[int, dict[str, int]] = {}
        below: dict[int, int] = {}

        def prune(v: int, most: int) -> None:
            own = kept[v]
            if len(own) > most:
                best = sorted(own.items(), key=lambda x: (x[1], x[0]))[:most]
                kept[v], below[v] = dict(best), best[-1][1]

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                for codes, tokens in sentences(t):
                    v = votes(codes)
                    counts[v] = counts.get(v, 0) + 1
                    h = crc32(" ".join(tokens).encode("utf-8", "surrogatepass"))
                    if h <= below.get(v, 1 << 32):
                        s = " ".join(meant(tokens))
                        own = kept.setdefault(v, {})
                        own[s] = h
                        most = VECTOR_ROWS if v else SILENT_ROWS
                        if len(own) > 2 * most:
                            prune(v, most)
        for v in list(kept):
            prune(v, VECTOR_ROWS if v else SILENT_ROWS)
        rows = [(v, n, None, None) for v, n in counts.items()] + [(v, None, s, h) for v, own in kept.items() for s, h in own.items()]
        for at in range(0, len(rows), 10_000):
            cols = zip(*rows[at : at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["votes", "n", "sentence", "hash"])

    return documents.select(text).mapInArrow(run, _SAMPLE)


def fit(found: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[LabelModel, Classifier]:
    """Label model over all vote vectors, classifier over at most ``train_rows`` distinct sentences."""
    counted = found.where("sentence IS NULL").groupBy("votes").agg(F.sum("n").alias("n")).collect()  # a row per vote vector that occurs
    vectors, counts = np.array([r["votes"] for r in counted] or [0], np.int64), np.array([r["n"] for r in counted] or [1])
    model = LabelModel(vectors, counts)
    most = _share(vectors, counts, train_rows)
    distinct = found.where("sentence IS NOT NULL").groupBy("votes", "sentence").agg(F.min("hash").alias("hash"))
    ranked = top_n(distinct.withColumn("smallest", -F.col("hash").cast("double")), ["votes"], "smallest", "sentence", SILENT_ROWS)
    limit = F.when(F.col("votes") == 0, min(SILENT_ROWS, 8 * most)).otherwise(most)
    sample = ranked.where(F.col("rank") <= limit).select("votes", "sentence").collect()  # at most train_rows, by the choice of ``most``
    rows = sorted((r["sentence"], r["votes"]) for r in sample)
    labels = model.posterior(np.array([v for _, v in rows] or [0], np.int64))[: len(rows)]
    return model, Classifier([(s.split(" "), v) for s, v in rows], labels)


def _share(vectors: np.ndarray, counts: np.ndarray, rows: int) -> int:
    """The most sentences of one vector (eight times that without a vote) with which the sample stays within ``rows``."""
    low, high = 0, VECTOR_ROWS
    while low < high:
        mid = (low + high + 1) // 2
        least = np.where(vectors == 0, min(SILENT_ROWS, 8 * mid), mid)
        low, high = (mid, high) if np.minimum(counts, least).sum() <= rows else (low, mid - 1)
    return low


def score_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score, worst)``: every document's score and the sentence that it comes from (null if it has no words)."""
    _, classifier = fit(written(vote_table(documents, text), "votes"))
    shared = documents.sparkSession.sparkContext.broadcast(classifier)  # voters + HASHED numbers
    nothing = classifier.score([], 0)
    schema = T.StructType([documents.schema[key], T.StructField("score", T.DoubleType()), T.StructField("worst", T.StringType())])

    def run(batches):
        c = shared.value
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            tokens, lengths, vectors, of = [], [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                for codes, own in sentences(t) if t else ():
                    tokens += own
                    lengths.append(len(own))
                    vectors.append(votes(codes))
                    of.append(r)
            best, said = [nothing] * batch.num_rows, [None] * batch.num_rows
            ends = [0, *accumulate(lengths)]
            for k, (r, x) in enumerate(zip(of, c.scores(tokens, lengths, vectors).tolist())):
                if said[r] is None or x > best[r]:  # the first of equal ones
                    best[r], said[r] = x, k
            said = [k if k is None else " ".join(tokens[ends[k] : ends[k + 1]]).replace(_LINE, "").strip() for k in said]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.float64()), pa.array(said, pa.string())], schema.names)

    scored = documents.where(F.col(key).isNotNull()).select(key, text).mapInArrow(run, schema)
    return scored.groupBy(key).agg(F.max(F.struct("score", "worst")).alias("__w")).select(key, "__w.score", "__w.worst")
