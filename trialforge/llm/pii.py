"""Personal information inside free text: spans by regular expressions, confirmed by checksums, scored by their context.

Every pattern proposes spans with a base score; valid check digits (Luhn, mod 97, control letters) and context words nearby raise it,
words that announce a measurement, a seed or a version lower it; spans that reach THRESHOLD are kept. Where spans overlap, the kind
found first in the order address, email, id_number, phone, name wins. Matching runs on a view of the text in which full-width forms,
odd spaces, dashes and apostrophes have their plain counterpart; the view has as many characters as the text, so positions are
the text's own, in Unicode code points.

Names are proposed wherever two or more words could be one: runs of capitalised words, and words in any case that a title, a person's
role, a verb of speech, a delimiter or a mail address stands next to. Whether a word is an ordinary one is told by the vocabulary of
a public tokenizer: ordinary words are in it in small letters. Unknown words make a name likely, ordinary ones unlikely, a common
given name and each sign of context add to the score.

Defined results: null and empty texts hold nothing; a text of any length is searched as a whole; a repeated passage is a case at
each of its places.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialforge.functions.partitions import spread

THRESHOLD = 0.5
KINDS = ("address", "email", "id_number", "phone", "name")

_VIEW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_VIEW |= {c: 0x20 for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x09)}
#: Capitals to small letters, one for one.
_SMALL = {c: ord(chr(c).lower()) for c in range(0x41, 0x250) if len(chr(c).lower()) == 1 and chr(c).lower() != chr(c)}
_VIEW |= {c: 0x2D for c in (*range(0x2010, 0x2016), 0x2212)} | {0x2019: 0x27, 0x2018: 0x27, 0x02BC: 0x27}


def _re(pattern: str, flags: int = 0) -> regex.Pattern:
    return regex.compile(pattern, regex.V1 | flags)


# --- addresses -------------------------------------------------------------------------------------------------------

# Words that end the name of an English street, begin a French or a Spanish one, and name a flat.
_STREET_EN = "street st road rd row lane ln crescent court ct avenue ave boulevard blvd drive dr way place square sq terrace close walk gardens grove hill mews parade quay".split()
_STREET_FR = "rue avenue quai allée allee place impasse boulevard chemin cours route passage square".split()
_STREET_ES = "calle plaza avenida avda paseo camino carretera ronda travesía via vía callejón".split()
_FLAT = "flat|apt|apartment|unit|suite|room|floor"
_POSTCODE = r"(?:[A-Z]{2}[ ]\d{5}(?:-\d{4})?|\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[A-Z\d]?[ ]?\d[A-Z]{2})"
_GAP = r"(?:,?[ ]*\r?\n[ ]*|,[ ]*|[ ]+)"
_WORD = r"[\p{Latin}\p{M}][\p{Latin}\p{M}'-]*"
_TOWN = rf"\p{{Lu}}[\p{{Latin}}\p{{M}}'-]+(?:[ ]\p{{Lu}}[\p{{Latin}}\p{{M}}'-]+){{0,2}}"
# flat, number and the words before an English street's last word; what follows it: flat, town, postcode
_HEAD = _re(rf"(?r)(?<![\w.-])(?:(?:{_FLAT})\.?[ ]\d{{1,4}}[A-Z]?{_GAP})?\d{{1,5}}[A-Z]?[ ](?:{_WORD}[ ]){{1,4}}?", regex.I)
_TAIL = _re(rf"\.?(?:{_GAP}(?:{_FLAT})\.?[ ]\d{{1,4}}[A-Z]?)?{_GAP}{_WORD}(?:[ ]{_WORD}){{0,3}}?{_GAP}{_POSTCODE}(?![\w-])", regex.I)
#: The other orders, and whether they hold one of the street words.
_ADDRESS = [
    # number, street, postcode, town
    (True, _re(rf"(?<![\w.-])\d{{1,5}}[A-Za-z]?(?:[ ](?:bis|ter|quater))?,?[ ](?i:{'|'.join(_STREET_FR)})[ ]{_WORD}(?:[ ]{_WORD}){{0,5}}{_GAP}\d{{5}}[ ]{_WORD}(?:[ ]\p{{Lu}}[\p{{Latin}}\p{{M}}'-]+){{0,2}}(?!\w)")),
    # street, number, postcode, town
    (True, _re(rf"(?<!\w)(?i:{'|'.join(_STREET_ES)})\.?[ ]{_WORD}(?:[ ]{_WORD}){{0,5}},?[ ]\d{{1,5}}[A-Za-z]?{_GAP}\d{{5}}[ ]{_WORD}(?:[ ]\p{{Lu}}[\p{{Latin}}\p{{M}}'-]+){{0,2}}(?!\w)")),
    (False, _re(rf"(?<!\w)(?:\p{{Lu}}[\p{{Latin}}\p{{M}}'-]+\.?[ ]){{1,4}}\d{{1,5}}[ ]?[A-Za-z]?{_GAP}\d{{5}}[ ]{_TOWN}(?!\w)")),
    (False, _re(rf"(?<=\b(?:an|Anschrift:|Adresse:|wohnt in|nach)[ ])(?:{_WORD}\.?[ ]){{1,4}}\d{{1,5}}[ ]?[A-Za-z]?{_GAP}\d{{5}}[ ]{_WORD}(?:[ ]\p{{Lu}}[\p{{Latin}}-]+)?(?!\w)")),
]
_FIVE_AND_TOWN = _re(r"\d{5}[ ][\p{Latin}]")

# --- mail ------------------------------------------------------------------------------------------------------------

_LOCAL = r"[\p{Latin}\p{M}\d](?:[\p{Latin}\p{M}\d_%+'-]|\.(?=[\p{Latin}\p{M}\d_%+-]))*"
_LABEL = r"[\p{Latin}\p{M}\d](?:[\p{Latin}\p{M}\d-]*[\p{Latin}\p{M}\d])?"
_TOP = r"\p{Latin}{2,}"
_MARK_DOT = r"(?:\.|[ ]?[\(\[\{][ ]?(?:dot|punkt|punto|point)[ ]?[\)\]\}][ ]?)"
_WORD_DOT = r"[ ](?:dot|punkt|punto|point)[ ]"
_EMAIL = [
    _re(rf"(?<![\p{{Latin}}\d_.+-]){_LOCAL}(?:[ ]?@[ ]?|[ ]?[\(\[\{{][ ]?(?:at|@)[ ]?[\)\]\}}][ ]?){_LABEL}(?:(?:{_MARK_DOT}|{_WORD_DOT}){_LABEL})*(?:{_MARK_DOT}|{_WORD_DOT}){_TOP}(?![\p{{Latin}}\d_]|-[\p{{Latin}}\d])", regex.I),
    _re(rf"(?<![\p{{Latin}}\d_.+-]){_LOCAL}[ ]at[ ]{_LABEL}(?:(?:{_MARK_DOT}|{_WORD_DOT}){_LABEL})*?{_WORD_DOT}{_TOP}(?:{_WORD_DOT}{_TOP})*(?![\p{{Latin}}\d_]|-[\p{{Latin}}\d])", regex.I),
]

_AT = _re(r"(?:@|[\(\[\{][ ]?(?i:at)[ ]?[\)\]\}])(?=[ ]?[\p{Latin}\p{M}\d-]+(?:\.|[ ]?[\(\[\{][ ]?(?i:dot|p)|[ ](?i:dot|p)))")
_IN_LOCAL = _re(r"[\p{Latin}\p{M}\d_%+'.-]")

# --- numbers ---------------------------------------------------------------------------------------------------------

# letters of other scripts may stand next to a number without a space
_N = r"\p{Latin}\d_"
_B, _E = rf"(?<![{_N}.+/\-]|\d,)", rf"(?![{_N}]|[.\-/:,]\d)"
_ID = [
    (0.5, _re(rf"{_B}\d{{3}}([- ])\d{{2}}\1\d{{4}}{_E}")),
    (0.8, _re(rf"{_B}\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}}{_E}")),
    (0.7, _re(rf"(?<![\p{{Latin}}\d_-])[A-Z]{{2}}[ ]?\d{{2}}[ ]?\d{{2}}[ ]?\d{{2}}[ ]?[A-D](?![\p{{Latin}}\d_-])")),
    (0.6, _re(r"(?<![\p{Latin}\d_-])[A-Z]{1,2}\d{7,8}(?![\p{Latin}\d_-])")),
    (0.7, _re(rf"{_B}\d{{8}}-?[A-Z](?![\p{{Latin}}\d_-])")),
    (0.3, _re(rf"{_B}[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z\d]{{4}}){{2,7}}(?:[ ]?[A-Z\d]{{1,3}})?(?![\p{{Latin}}\d_-])")),
    (0.3, _re(rf"{_B}\d{{4}}([- ]?)\d{{4}}\1\d{{4}}\1\d{{1,7}}{_E}")),
    (0.2, _re(rf"{_B}(?:\d{{8,9}}|\d{{11}}){_E}")),
]
#: Every number of a kind below has six digits or more, with little between them.
_NUMERIC = _re(r"\d(?:[ ()./-]{0,3}[\dA-Z]){5}")
_ID_CUE = _re(r"(?:ssn|security|passport|pass(?:e?port)?nummer|\bid\b|identit|ausweis|documento|card|annotator_id|\bdni\b|\bnie\b|typed|badge|证件|身份证|护照|番号|tax|licen[cs]e|lists)[^\n]{0,40}$", regex.I)
_NOT_CUE = _re(r"(?:tokens?|param|params|count|range|items?|seeds?|run|step|steps|job|lr|attempt|batch|sizes|checkpoints?|loss|score|version|build|commit|hash|offset|bytes|shape)[ :=#]*(?:\w+[ ])?$", regex.I)
_EXT = r"(?:[ ]?(?:[Ee]xt\.?|EXT\.?|[xX]|[Ee]xtension|[Dd]urchwahl|[Pp]oste)[ ]?\d{1,5})?"
_PB, _PE = rf"(?<![{_N}.+/-])", rf"(?![{_N}]|[.\-/]\d)"
_PHONE = [
    (0.5, _re(rf"{_PB}(?<!\d[ ])0\d(?:[ .]\d{{2}}){{4}}{_EXT}{_PE}")),
    (0.8, _re(rf"{_PB}(?:\+|00[ ]?)[1-9]\d{{0,2}}[ .-]?(?:\(0?\d{{0,4}}\)[ .-]?)?\d{{1,5}}(?:[ ./-]?\d{{2,5}}){{1,5}}{_EXT}{_PE}")),
    (0.6, _re(rf"{_PB}(?:\+?1[ .-])?(?:\(\d{{3}}\)[ ]?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}{_EXT}{_PE}")),
    (0.5, _re(rf"{_PB}(?:\(0\d{{1,4}}\)[ ]?\d{{3,5}}[ -]?\d{{3,5}}|0\d{{1,4}}[ /-]\d{{3,5}}[ -]\d{{3,5}}|0\d{{1,4}}[ /-]\d{{6,9}}){_EXT}{_PE}")),
    (0.2, _re(rf"{_PB}\d{{3}}-\d{{4}}{_EXT}{_PE}")),
    (0.2, _re(rf"{_PB}[1-9]\d{{9}}{_EXT}{_PE}")),
]
_PHONE_CUE = _re(r"(?:tel|phone|fon|mobile?|cell|call|number|text me|ring|operator on|fax|appeler|appelle[rz]?|llama[rd]?|anrufen|電話|电话|手机)[^\n\d]{0,16}$", regex.I)


# Fixed value: the control letters of Spanish identity numbers, by remainder.
_CONTROL = "TRWAGMYFPDXBNJZSQVHLCKE"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _control_letter(text: str) -> bool:
    """Whether the letter after eight digits is the one that their remainder by 23 gives."""
    return text[8:].lstrip("-") == _CONTROL[int(text[:8]) % 23]


def _two_check_digits(digits: str) -> bool:
    """Whether the last two of eleven digits follow from the nine before them (weights from 10 and 11 down, modulo 11)."""
    for n in (9, 10):
        if sum(int(d) * (n + 1 - i) for i, d in enumerate(digits[:n])) * 10 % 11 % 10 != int(digits[n]):
            return False
    return True


def _mod97(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


# --- names -----------------------------------------------------------------------------------------------------------

# Common given names of several languages, in small letters.
_GIVEN = frozenset("""
aaron abdul adam ahmed aisha alan albert alejandro alex alexander alice ali amanda amina amir amy ana andrea andrei andrew angela anita
ann anna anne anthony antonio arjun arthur ashley barbara ben benjamin beth brian bruno carla carlos carmen carol catherine charles chen
chris christian christine claire claudia daniel david deborah deepak diana diego dmitri dorothy elena elizabeth ella emily emma eric
erik eva fatima felix fernando francesca francisco frank fred gabriel george giulia grace greg hannah hans hassan heidi helen henry
hiroshi hugo ibrahim igor ines ingrid irene isabel ivan jack jakob james jan jane jason javier jean jennifer jessica joao john jonas
jorge jose joseph juan julia julie karen karl kate katherine kenji kevin khalid klaus kumar lars laura leila linda lisa louis lucas
lucia luis maria marie mario mark marta martin mary matthew mei michael miguel mohammed monica nadia natalia nicole nina noah olga
oliver omar oscar pablo patricia paul pedro peter pierre priya rachel raj ravi rebecca richard robert rosa ruth samuel sandra sara
sarah sergio sofia sophie stefan stephen susan sven thomas tom victor wei will yuki yusuf
""".split())
_TITLES = frozenset("mr mrs ms miss mx dr prof professor sir madam herr frau hr fr sr sra srta don doña señor señora mme mlle monsieur madame dott ing".split())
_PARTICLES = frozenset("van von de del della di da dos du bin ibn al el ter ten zu der den la las los le dem y".split())
# words that are capitalised at the start of sentences in languages of which the vocabulary has few words, and calendar names
_ORDINARY = frozenset("""
monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november
december montag dienstag mittwoch donnerstag freitag samstag sonntag lunes martes miércoles jueves viernes lundi mardi mercredi jeudi
vendredi im am beim zum zur nach zwei drei falls hemos preguntar demander tras english french german spanish chinese japanese latin
id ssn dni nie re fwd
""".split())
# a place or a street, not a person, follows or precedes
_PLACE = frozenset("rue avenue quai allée place impasse boulevard chemin calle plaza avenida paseo camino vía via street road lane row square court hollow straße strasse weg platz port east west north south saint".split())

_LETTERS = r"\p{Latin}\p{M}"
_CAP = rf"\p{{Lu}}(?:[{_LETTERS}]+(?:['-][{_LETTERS}]+)*|'[{_LETTERS}]+(?:-[{_LETTERS}]+)*)"
_INITIAL = r"\p{Lu}\."
_FORE = rf"(?:{_CAP}(?![{_LETTERS}])|{_INITIAL})"
_LEFT, _RIGHT = rf"(?<![{_LETTERS}\d_./'@-])", rf"(?![{_LETTERS}\d_@])"
_PARTICLE = r"(?:(?i:van|von|de|del|della|di|da|dos|du|bin|ibn|al|el|ter|ten|zu)(?:[ ](?i:der|den|la|las|los|dem))?)"
_RUN = _re(rf"{_LEFT}{_FORE}(?:[ ](?:{_PARTICLE}[ ])?{_FORE})+{_RIGHT}")
_COMMA = _re(r"(?<=[\p{Latin}\p{M}]),[ ](?=\p{Lu})")
_TURNED = _re(rf"(?r){_LEFT}(?:{_PARTICLE}[ ])?{_CAP}")
_TWO_BEFORE = _re(rf"(?r){_LEFT}{_CAP}[ ]{_CAP}")
_TURNED_REST = _re(rf"{_FORE}(?:[ ]{_FORE})?{_RIGHT}")
_W = rf"(?:\p{{Latin}}\.|[{_LETTERS}]+(?:['-][{_LETTERS}]+)*)"
_ANY = _re(rf"{_W}(?:[ ]{_W}){{1,5}}|{_W}(?:[ ]{_W}){{0,2}},[ ]{_W}(?:[ ]{_W})?")
_BACK = _re(rf"(?r){_LEFT}{_W}(?:,?[ ]{_W}){{1,4}}")
_WORDS = _re(rf"[{_LETTERS}]+(?:['-][{_LETTERS}]+)*\.?")

# Context: what stands before a person's name, in three groups, and what stands after it.
# Words that stand before a person's name: titles, roles, and verbs or nouns that take a person; the rest of what stands between.
_CUES = {
    "title": "mr mrs ms miss mx dr prof professor sir madam herr herrn frau hr sr sra srta señor señora doña mme mlle monsieur madame dott".split(),
    "role": """reviewer rater annotator author owner colleague engineer manager director assistant analyst scientist researcher patient client
        customer employee contact signed attn attention cc from name named kontakt betreuer autor autora responsable usuario regards thanks
        cheers wishes sincerely saludos grüße cordialement""".split(),
    "verb": """ask asked blame contact call email tell told thank meet met ping notify cc by says said wrote lists quotes dear hi hello bitte
        fragen sie|demander à|demandez à|pregunta a|preguntar a|contactar a|escribe a""".replace("\n", " ").split("|"),
    "of": "badge sheet claim record file form profile account letter request desk office signature email phone address".split(),
    "han": "联系 请找 咨询 询问 通知 负责人是 作者是 姓名 担当 前に 連絡先は 作成者は 責任者は".split(),
    "after_han": "已 说 表示 认为 先生 女士 老师 同学 签 批准 确认 负责 来 去 昨天 今天 明天 在 打电话 写道 さん 様 氏 です".split(),
    # after a name, in any case
    "after": "said says signed reran approved confirmed wrote asked pointed reported resigned agreed replied aprobó firmó dijo confirmó sagte".split(),
    "mark": ["m.", "(or"],
    "dot": "dot punkt punto point".split(),
    "street": _STREET_EN,
    "rue": sorted({*_STREET_FR, *_STREET_ES}),
}
_CUES["verb"] = [w for x in _CUES["verb"] for w in ([x.strip()] if " à" in x or " a" in x[-2:] else x.split())] + ["fragen sie"]
_REST = {
    "title": _re(r"\.?\s+(?:(?:dr|prof|mr|mrs|ms)\.?\s+)?", regex.I),
    "role": _re(r"""(?:'s)?(?:\s+(?:is|note|name|to|with))?"?\s*[:,("]*\s*"?(?:(?:dr|prof|mrs?|ms|frau|herrn?|sra?|mme|m)\.?\s+)?""", regex.I),
    "verb": _re(r"[ ]+(?:(?:dr|prof|mrs?|ms|frau|herrn?|sra?|mme)\.?\s+)?", regex.I),
    "of": _re(r"[ ]+(?:of|from)[ ]+(?:(?:dr|prof|mrs?|ms|frau|herrn?|sra?|mme)\.?\s+)?", regex.I),
    "han": _re(r"(?:者|人)?(?:は|是|[:：])?\s*"),
    "mark": _re(r"[ ]+"),
}
_CLOSE = r"[ ]?(?:[\]|;:<)\"”(]|\r?\n|$)"
_MARK_AFTER = _re(_CLOSE)
_MARKED = _re(rf"(?:[\[|@(\"“;•]|\n(?:[*-][ ])?)[ ]?({_W}(?:[ ]{_W}){{1,5}}|{_W}(?:[ ]{_W}){{0,2}},[ ]{_W}(?:[ ]{_W})?)(?={_CLOSE})")
_MARKED_FIRST = _re(rf"({_W}(?:[ ]{_W}){{1,5}}|{_W}(?:[ ]{_W}){{0,2}},[ ]{_W}(?:[ ]{_W})?)(?={_CLOSE})")
_SPEECH = r"(?:said|says|signed|reran|ran|approved|confirmed|wrote|writes|asked|pointed|reported|resigned|agreed|called|joined|left|met|replied|noted|thinks|promised|works|worked|lives|lived|moved|sent|told|claims|claimed|suggested|reviewed|submitted|will|has|hat|war|ist|fragte|sagte|fragen|anrufen|schrieb|aprobó|firmó|dijo|confirmó|escribió|trabaja|pidió)\b"
_AND_TITLE = r"[ ](?:and|und|et|y)[ ](?:mrs?|ms|dr|prof|herr|frau|sra?|mme)\.?[ ]"
_AFTER = _re(rf"'s\b|[ ]{_SPEECH}|,?[ ](?:who|whose)\b|[ ]a[ ](?:validé|signé|confirmé|dit|écrit|approuvé|demandé)|[ ](?:avant|antes|before)[ ]|[ ]?(?:さん|です|様|氏|已)|{_AND_TITLE}", regex.I)
_OTHER_AFTER = _re(rf"'s\b|{_AND_TITLE}|已|さん|です")
_AND = _re(r"[ ](?:and|und|et|y|or|oder|ou)[ ](?:(?:mrs?|ms|dr|prof|herr|frau|sra?|mme)\.?[ ])?\(?|[ ]\(or[ ]", regex.I)
_LISTED = _re(r",[ ](?!(?:and|und|et|y)\b)")
_JOIN = _re(r"[ ]{0,2}[|;<,(/][ ]{0,2}|\r?\n|\",[ ]\"\w+\":[ ]\"")
_FRENCH = _re(r"[ ](?:a|est|était|va|dit|pense|avait)[ ]")

_HAN = r"[\p{Han}々ヶ]"
# The commonest Chinese family names.
_FAMILY_HAN = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高梁郑谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤"
_HAN_SAYS = "已|说|表示|认为|先生|女士|老师|同学|签|批准|确认|负责|来|去|昨天|今天|明天|在|打电话|写道"
_HAN_NAME = [
    (0.6, _re(rf"(?<=联系|联系人[:：]?|请找|咨询|询问|通知|负责人是|作者是|姓名[:：]?){_HAN}{{2,4}}(?=[。，、；,.;\s）)]|$)")),
    (0.6, _re(rf"(?<!{_HAN}){_HAN}{{2,4}}(?=已确认|已签|已批准|先生|女士|老师)")),
    (0.6, _re(rf"(?<!{_HAN})[{_FAMILY_HAN}]{_HAN}{{1,2}}?(?={_HAN_SAYS})")),
    (0.7, _re(rf"(?<=担当は|担当者は|担当[:：]|作成者は|連絡先は|責任者は){_HAN}{{1,4}}[ ]?{_HAN}{{1,4}}(?=です|さん|様|氏|が|に|へ)")),
    (0.7, _re(rf"(?<!{_HAN}|{_HAN}[ ]){_HAN}{{1,4}}[ ]?{_HAN}{{1,4}}(?=さん|様|氏)")),
    (0.6, _re(rf"(?<=^|[。、\s「（]){_HAN}{{1,4}}[ ]{_HAN}{{1,4}}(?=が|は|です)")),
]


class Lexicon:
    """Which words are ordinary: those that the vocabularies of public tokenizers hold in small letters, as whole words."""

    def __init__(self, merges: str, ranks: str):
        own = json.load(open(merges, encoding="utf-8"))["model"]["vocab"]
        words = {t[1:] for t in own if t[:1] == "Ġ"}
        for line in open(ranks, "rb"):
            token = base64.b64decode(line.split()[0])
            if token[:1] == b" ":
                try:
                    words.add(token[1:].decode())
                except UnicodeDecodeError:
                    continue
        self.words = frozenset(w for w in words if len(w) > 1 and w.isalpha() and w.islower())

    def ordinary(self, word: str) -> bool:
        """Whether a word, all its parts if it has a hyphen, is an ordinary one."""
        w = word.casefold()
        if w in self.words or w in _ORDINARY:
            return True
        parts = w.replace("'", "-").split("-")
        return len(parts) > 1 and all(len(x) < 2 or x in self.words or x in _ORDINARY for x in parts)


@lru_cache(maxsize=1)
def lexicon(merges: str | None = None, ranks: str | None = None) -> Lexicon:
    """The lexicon of two vocabulary files; each worker reads them once."""
    import public_tokenizers

    return Lexicon(merges or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


class Names:
    """find(view, spans) gives the spans of names in a text, with their scores; spans are those of other kinds, which a name may stand
    next to."""

    def __init__(self) -> None:
        self.lexicon = lexicon()

    def find(self, view: str, hits: dict[str, list[tuple[int, int]]], starts: set[int], ends: set[int]) -> list[tuple[int, int, float]]:
        self.view, self.starts, self.ends = view, starts, ends
        cues: set[int] = set()
        for kind, rest in _REST.items():
            cues |= {m.end() for _, e in hits.get(kind, ()) if (m := rest.match(view, e))}
        self.cued = cues
        found: dict[tuple[int, int], float] = {}

        def propose(a: int, b: int, extra: float = 0.0) -> None:
            if (cut := self._cut(a, b)) is not None:
                span, base = cut
                found[span] = max(found.get(span, 0.0), base + extra + self._context(*span))

        for p in _HAN_NAME if "han" in hits or "after_han" in hits else ():
            for m in p[1].finditer(view):
                found[m.span()] = max(found.get(m.span(), 0.0), p[0])
        for m in _COMMA.finditer(view):
            if (n := _TURNED.match(view, 0, m.start())) and (e := _TURNED_REST.match(view, m.end())):
                if not self._run_before(n.start()):
                    propose(n.start(), e.end())
                elif (two := _TWO_BEFORE.match(view, 0, m.start())) and e.group().split(" ")[0].casefold() in _GIVEN and not self._run_before(two.start()) and two.group().split(" ")[0].casefold() not in _GIVEN:
                    # a surname of two words before a given name
                    propose(two.start(), e.end(), 0.1)
        for m in _RUN.finditer(view):
            propose(*m.span())
        for at in cues:
            if (n := _ANY.match(view, at)) and (b := self._reach(n)) is not None:
                propose(at, b)
        if m := _MARKED_FIRST.match(view):
            propose(*m.span(1))
        for m in _MARKED.finditer(view):
            propose(*m.span(1))
        for at in [*(m.start() for m in _OTHER_AFTER.finditer(view)), *(a - 1 for a, _ in hits.get("after", ()) if view[a - 1 : a] == " ")]:
            if (n := _BACK.match(view, 0, at)) and (a := self._reach_back(n)) is not None:
                propose(a, n.end())
        # a name beside a name, and one after another in a list
        begins: dict[int, list[tuple[int, int]]] = {}
        for span in found:
            begins.setdefault(span[0], []).append(span)
        for span in sorted(found):
            if m := _AND.match(view, span[1]):
                others = begins.get(m.end(), [])
                if found[span] >= THRESHOLD:
                    for o in others:
                        found[o] += 0.3 * (found[o] < THRESHOLD)
                elif any(found[o] >= THRESHOLD for o in others):
                    found[span] += 0.3
        for span in sorted(found):
            if found[span] >= THRESHOLD and (m := _LISTED.match(view, span[1])):
                for o in begins.get(m.end(), []):
                    found[o] += 0.2 * (0.3 <= found[o] < THRESHOLD)
        return [(a, b, x) for (a, b), x in found.items()]

    def _words(self, a: int, b: int) -> list[tuple[int, int, str]]:
        return [(a + w.start(), a + w.end(), w.group()) for w in _WORDS.finditer(self.view[a:b])]

    def _run_before(self, at: int) -> bool:
        """Whether a capitalised word that isn't an ordinary one stands right before: then the words before the comma belong to it."""
        m = _re_word_before.match(self.view, 0, at)
        return bool(m) and m.group(1)[:1].isupper() and not self.lexicon.ordinary(m.group(1)) and m.group(1).casefold() not in _TITLES

    def _unknown(self, word: str) -> bool:
        w = word.rstrip(".").casefold()
        if len(w) == 1:
            return word.endswith(".") or word.isupper()
        return w in _PARTICLES or w in _GIVEN or not self.lexicon.ordinary(w)

    @staticmethod
    def _alike(before: list[tuple[int, int, str]], word: str) -> bool:
        """A capitalised name doesn't go on with a small word that is no particle."""
        return not word.islower() or word in _PARTICLES or not any(w[:1].isupper() and len(w.rstrip(".")) > 1 and w.casefold() not in _PARTICLES for _, _, w in before)

    def _reach(self, n: regex.Match) -> int | None:
        """How far a name reaches that begins here, in any case: up to the first ordinary word; the first may be one, as may the last
        before a mark or the end of the line."""
        words = self._words(*n.span())
        while words and words[0][2].rstrip(".").casefold() in _TITLES:
            words.pop(0)
        k = 0
        while k < len(words) and self._unknown(words[k][2]) and self._alike(words[:k], words[k][2]):
            k += 1
        content = sum(len(w.rstrip(".")) > 1 and w.casefold() not in _PARTICLES for _, _, w in words[:k])
        if content == 1 and k < len(words) and (_re_end.match(self.view, words[k][1]) or _AFTER.match(self.view, words[k][1])) and words[k][2][:1].isupper() == words[0][2][:1].isupper():
            k += 1
        if k == 0 and len(words) > 1 and words[0][2].casefold() in _SOFT:
            k = 1
            while k < len(words) and self._unknown(words[k][2]):
                k += 1
        while k and words[k - 1][2].casefold() in _PARTICLES:
            k -= 1
        return words[k - 1][1] if k >= 2 else None

    def _reach_back(self, n: regex.Match) -> int | None:
        words = self._words(*n.span())
        k = len(words)
        while k and self._unknown(words[k - 1][2]):
            k -= 1
        if k and words[k - 1][2].casefold() in _SOFT and len(words) - k >= 1:
            k -= 1
        while k < len(words) and words[k][2].casefold() in _PARTICLES - {"van", "von", "de", "del", "di", "da", "al", "el", "bin", "ter", "zu"}:
            k += 1
        return words[k][0] if len(words) - k >= 2 else None

    def _cut(self, a: int, b: int) -> tuple[tuple[int, int], float] | None:
        """The span without titles and ordinary words at its start, and its base score; None if it can't be a name."""
        view, words = self.view, self._words(a, b)
        turned = "," in view[a:b]
        while words:
            w = words[0][2].rstrip(".").casefold()
            initial = words[0][2].endswith(".") and len(w) == 1
            title = w in _TITLES and not initial or w == "m" and initial and len(words) > 2 and _FRENCH.match(view, b)
            if title or not initial and w not in _GIVEN and w not in _SOFT and w not in _PARTICLES and self.lexicon.ordinary(w):
                # a surname may be an ordinary word where it comes first
                if not title and len(words) == 2 and words[1][2].casefold() in _GIVEN and words[0][0] in self.cued:
                    break
                if turned and len(words) == 2 and not title and (self._unknown(words[1][2]) or words[1][2].casefold() in _SOFT):
                    break
                words.pop(0)
            else:
                break
        while words and words[0][2].casefold() in ("la", "le", "el", "los", "las", "y", "der", "den", "al") and not turned and words[0][2][:1].isupper():
            words.pop(0)
        if words and (words[-1][2].casefold() in _PARTICLES):
            words.pop()
        if len(words) < 2:
            return None
        end = words[-1][1]
        if words[-1][2].endswith(".") and len(words[-1][2]) > 2:
            end -= 1
        if view[end - 2 : end] in ("'s", "'S"):
            end -= 2
        body = [w.rstrip(".").casefold().removesuffix("'s") for _, _, w in words]
        full = [w for w in body if len(w) > 1 and w not in _PARTICLES]
        if not full or len(words) > 6:
            return None
        before = _re_word_before.match(view, 0, words[0][0])
        after = _re_word_after.match(view, end)
        if any(w in _PLACE for w in full[:1] + full[-1:] if w not in _GIVEN and "-" not in w) or (before and before.group(1).casefold() in _PLACE) or (after and after.group(1)[:1].isupper() and after.group(1).casefold() in _PLACE):
            return None
        plain = [w for w in full if self.lexicon.ordinary(w) and w not in _GIVEN]
        # ordinary words: none, the surname at the end, or a given name such as Will at the start
        hard = [w for w in plain if w not in _SOFT]
        if len(hard) > 1 or (hard and hard[0] not in (full[0], full[-1])):
            return None
        initials = sum(len(w) == 1 for w in body)
        if len(full) + initials < 2 or any(len(w) == 1 and not (t.endswith(".") or t.isupper()) for w, (_, _, t) in zip(body, words)):
            return None
        if hard and len(hard) == len(full) and not initials or all(w in _SOFT for w in full):
            return None
        known = any(w in _GIVEN and w not in _SOFT for w in full) or any(p in _GIVEN for w in full for p in w.split("-") if "-" in w)
        base = 0.3 - 0.1 * bool(hard) + (0.3 if known else 0.1 if full[0] in _SOFT else 0.0)
        text = view[words[0][0] : end]
        if text.islower():
            base -= 0.05
        elif text.isupper():
            base -= 0.05
        return (words[0][0], end), base

    def _context(self, a: int, b: int) -> float:
        """What stands around a span adds up to 0.6."""
        view, score = self.view, 0.0
        if a in self.cued:
            score += 0.3
        if _AFTER.match(view, b):
            score += 0.3
        mark, close = bool(_re_mark_before.match(view, 0, a)), bool(_MARK_AFTER.match(view, b))
        if mark and close:
            score += 0.3
        if (m := _JOIN.match(view, b)) and m.end() in self.starts or any(e in self.ends for e in range(max(0, a - 3), a)):
            score += 0.3
        return min(0.6, score)


_SOFT = frozenset("will mark grace april may june august jo dag art bill rose faith hope joy pat sue ray dawn iris ivy robin".split())
_re_word_before = _re(rf"(?r)([{_LETTERS}]+(?:['-][{_LETTERS}]+)*)[ ]")
_re_word_after = _re(rf"[ ]([{_LETTERS}]+)")
_re_end = _re(r"[ ]?(?:[\].|;:<)\"”,(!?]|\r?\n|$)")
_re_mark_before = _re(r"(?r)(?:^|[\[|@(\"“;\n]|[-*•])[ ]?")


class Finder:
    """find(text) gives the spans (begin, end, kind, score) of a text, in order."""

    def __init__(self) -> None:
        self.names = Names()
        self.cues = ahocorasick.Automaton()
        kinds: dict[str, list[str]] = {}
        for kind, words in _CUES.items():
            for w in words:
                kinds.setdefault(w, []).append(kind)
        for w, k in kinds.items():
            self.cues.add_word(w, (len(w), tuple(k)))
        self.cues.make_automaton()

    def _hits(self, view: str) -> dict[str, list[tuple[int, int]]]:
        """Where the cue words of each kind stand, as whole words, in any case; all in one pass."""
        hits: dict[str, list[tuple[int, int]]] = {}
        for last, (n, kinds) in self.cues.iter(view.lower() if view.isascii() else view.translate(_SMALL)):
            a, b = last + 1 - n, last + 1
            if kinds[0] in ("han", "after_han") or not (view[a - 1 : a].isalpha() or view[b : b + 1].isalnum()):
                for k in kinds:
                    hits.setdefault(k, []).append((a, b))
        return hits

    def find(self, text: str) -> list[tuple[int, int, str, float]]:
        view = text.replace("\t", " ") if text.isascii() else text.translate(_VIEW)
        spans: list[tuple[int, int, str, float]] = []
        taken = bytearray(len(view))

        def keep(a: int, b: int, kind: str, score: float) -> None:
            if b > a and score >= THRESHOLD and not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                spans.append((a, b, kind, round(score, 2)))

        hits = self._hits(view)
        for a, b in hits.get("street", ()):
            if (head := _HEAD.match(view, 0, a)) and (tail := _TAIL.match(view, b)):
                keep(head.start(), tail.end(), "address", 0.9)
        if _FIVE_AND_TOWN.search(view):
            for street, p in _ADDRESS:
                if not street or "rue" in hits:
                    for m in p.finditer(view):
                        keep(m.start(), m.end(), "address", 0.9)
        for sign in _AT.finditer(view):
            # from the sign back over what may stand in a local part
            a = sign.start() - (view[sign.start() - 1 : sign.start()] == " ")
            while a and _IN_LOCAL.match(view[a - 1]):
                a -= 1
            while a < sign.start() and view[a] in ".-'+%_":
                a += 1
            if m := _EMAIL[0].match(view, a):
                keep(m.start(), m.end(), "email", 0.9)
        if "dot" in hits:
            for m in _EMAIL[1].finditer(view):
                keep(m.start(), m.end(), "email", 0.9)
        ends = {s[1] for s in spans}
        numbers = bool(_NUMERIC.search(view))
        for base, p in _ID if numbers else ():
            for m in p.finditer(view):
                keep(m.start(), m.end(), "id_number", self._number(view, m, base, _ID_CUE, ends))
        for base, p in _PHONE if numbers else ():
            for m in p.finditer(view):
                keep(m.start(), m.end(), "phone", self._number(view, m, base, _PHONE_CUE, ends))
        # a number that stands alone is told by the phone or mail before it in the same record
        ends |= {s[1] for s in spans}
        for m in _ID[-1][1].finditer(view) if numbers else ():
            keep(m.start(), m.end(), "id_number", self._number(view, m, 0.2, _ID_CUE, ends))
        for a, b, score in sorted(self.names.find(view, hits, {x[0] for x in spans}, {x[1] for x in spans}), key=lambda x: (-x[2], x[0] - x[1])):
            keep(a, b, "name", score)
        return sorted(spans)

    @staticmethod
    def _number(view: str, m: regex.Match, base: float, cue: regex.Pattern, ends: set[int]) -> float:
        before = view[max(0, m.start() - 60) : m.start()]
        digits = "".join(c for c in m.group() if c.isdigit())
        score = base
        if cue.search(before):
            score += 0.5
        gap = before.rstrip(" \r\n;,/|<>")
        if m.start() - (len(before) - len(gap)) in ends and len(before) - len(gap) <= 4:
            score += 0.4
        if _NOT_CUE.search(before[-24:]):
            score -= 0.7
        if cue is _ID_CUE and 13 <= len(digits) <= 19 and m.group()[0].isdigit() and _luhn(digits):
            score += 0.3
        if cue is _ID_CUE and m.group()[:2].isalpha() and len(m.group().replace(" ", "")) >= 15 and _mod97(m.group().replace(" ", "")):
            score += 0.5
        if cue is _ID_CUE and len(digits) == 8 and m.group()[-1:].isalpha() and m.group()[:8].isdigit() and _control_letter(m.group()):
            score += 0.3
        if cue is _ID_CUE and len(digits) == 11 and "-" in m.group()[-3:] and _two_check_digits(digits):
            score += 0.3
        return score


def found(documents: DataFrame) -> DataFrame:
    """doc_id, pii_kind, begin_at and found_text of each passage; documents has doc_id and text. No shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            at, kind, begin, passage = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for a, b, k, _ in finder.find(text):
                    at.append(i)
                    kind.append(k)
                    begin.append(a)
                    passage.append(text[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kind, pa.string()), pa.array(begin, pa.int64()), pa.array(passage, pa.string())], ["doc_id", "pii_kind", "begin_at", "found_text"])

    flat = spread(documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.col("text") != "")))
    return flat.mapInArrow(work, "doc_id bigint, pii_kind string, begin_at bigint, found_text string")


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """The text with a placeholder such as [EMAIL] for each span and all else unchanged."""
    out, at = [], 0
    for a, b, kind, _ in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redacted(documents: DataFrame) -> DataFrame:
    """doc_id and text with typed placeholders; null and empty texts stay as they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            texts = [t if not t else redact(t, finder.find(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "redacted_text"])

    return spread(documents.select("doc_id", "text")).mapInArrow(work, "doc_id bigint, redacted_text string")
