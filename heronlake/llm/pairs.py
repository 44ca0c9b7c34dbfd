"""Broken prompt and response pairs.

Responses and their sentence units are sorted and compared with their neighbours: an ending that a
neighbour carries on is a shortened version, an ending that stands elsewhere as a finished unit is
not. Endings that neither tells are left to a classifier of unfinished endings, which is fitted on
finished units and on the same units cut at random; lengths at which unfinished responses pile up
lower its threshold. Empty, copied, refusing and foreign answers are found by rules on each pair.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from ..plans.neighbours import carried_on
from ..plans.skew import heavy_keys, salted_join
from .common import INVISIBLE, logistic

DEFECTS = ("empty", "copied", "refusal", "language", "truncated")
#: Bound on the finished units from which the classifier of endings learns.
TRAIN_UNITS = 30_000
#: Bound on the phrases (the most frequent ones) from which it learns besides.
TRAIN_PHRASES = 2_000
#: Share of the questions with unfinished answers (and least number of them) under which one answer without
#: an end mark recurs before it is taken for a phrase; repeated pairs count once.
PHRASE_SHARE, PHRASE_LEAST = 0.004, 2
#: Share of the unfinished texts (and least number of them) that a spike of one length holds.
SPIKE_SHARE, SPIKE_LEAST = 0.012, 5

_TAGS = re.compile(r"<[A-Za-z/!?][^<>]*>")
_ENTITIES = re.compile(r"&(?:nbsp|zwnj|zwj|#160|#8203);")
_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")
_WORD = re.compile(r"[^\W_]+")
_SHOWN = re.compile(r"[^\W_]")
_EDGES = " \t\r\n\"'.,;:!?()[]{}<>*_-/\\|"
_WIDE = re.compile(r"[぀-ヿ㐀-鿿฀-๿]")
_LEAD = re.compile(
    r"^\W*(?:(?:the\s+)?(?:question|answer|response|q|a|you asked|the question (?:is|was)|frage|antwort|question\s*:|réponse|pregunta|respuesta|вопрос|ответ|问题|回答|质问|質問|答え|答案)(?:\s+(?:is|was|lautet|est|es))?\s*[:：.-]\s*)+",
    re.I,
)
_PLACEHOLDER = re.compile(
    r"(?:the\s+)?(?:n\s?/?\s?a|nan|none|null|nil|tbd|todo|tba|empty|blank|undefined|missing|unknown|no answer|no response|not available|not applicable|(?:model |final |correct )?answer|response|output|a|q|question|antwort|réponse|respuesta|ответ|回答|答案|答え|keine antwort|sin respuesta|pas de réponse|placeholder|lorem ipsum)?",
    re.I,
)


def visible(text: str | None) -> str:
    """Text without tags, entities and characters that show nothing."""
    if not text:
        return ""
    t = _TAGS.sub(" ", text) if "<" in text else text
    t = _ENTITIES.sub(" ", t) if "&" in t else t
    return (_CONTROL if t.isascii() else INVISIBLE).sub("", t).strip()


def is_empty(answer: str | None) -> bool:
    """Null, blank, invisible, or only a placeholder or label. "No." and "None known." are answers."""
    return _says_nothing(visible(answer))


def _says_nothing(t: str) -> bool:
    if not _SHOWN.search(t):
        return True
    core = re.sub(r"\s+", " ", t).strip(" \t\n\"'“”„«».:;!?…[](){}<>*_-–—=|/\\，。：") if len(t) < 200 else t
    if len(core) > 40:  # longer than any placeholder
        return False
    if core.lower() in ("a", "q"):
        return bool(re.fullmatch(r"\W*[aq]\s*[:：]\W*", t, re.I))
    return bool(_PLACEHOLDER.fullmatch(core))


def _tokens(text: str) -> list[str]:
    t = unicodedata.normalize("NFKC", text).lower()
    out = []
    for w in _WORD.findall(t):
        out += list(w) if _WIDE.search(w) else [w]
    return out


def is_copy(question: str | None, answer: str | None) -> bool:
    """The answer is the question again and nothing else: whatever its case, punctuation, spacing
    or lead-in, repeated, or with a word lost."""
    if not question or not answer:
        return False
    # a copy ends with letters of the question, whatever else was changed
    end = answer.rstrip(_EDGES)[-3:]
    if question.isascii() and end.isascii() and end.isalnum() and end.lower() not in question.lower():
        return False
    q, a = _tokens(question), _tokens(_LEAD.sub("", visible(answer)))
    if not q or not a:
        return False

    def once(part: list[str], full: list[str]) -> bool:
        if part == full:
            return True
        lost = len(full) - len(part)
        wide = sum(len(w) == 1 and bool(_WIDE.search(w)) for w in full) > len(full) / 2
        if lost <= 0 or len(full) < 3 or lost > (max(1, len(full) // 3) if wide else max(1, len(full) // 12)):
            return False
        it = iter(full)
        return all(w in it for w in part)

    if once(a, q) or once(a, (lead := _tokens(_LEAD.sub("", question)))) or (lead and a == lead):
        return True
    n = round(len(a) / len(q))
    return n > 1 and all(a[i] == q[i % len(q)] for i in range(len(a))) and len(a) % len(q) == 0


# ---- refusals ------------------------------------------------------------------------------

#: A refusal is told by what its sentence does: somebody who answers (or the question itself), a word of
#: not being able, willing or allowed, and a word of answering.
_WHO = re.compile(r"\b(?:i|we|me|us|my|our|mine|assistant|model|ai|questions?|requests?|quer(?:y|ies)|answers?|topics?|subjects?|matters?|context|information|documents?|passages?|kind|sort)\b|i['’](?:m|d|ll|ve)\b")
_CANNOT = re.compile(
    r"\b(?:can ?not|can['’]?t|could(?: not|n['’]t)|(?:will not|won['’]t|wo n['’]t)|(?:would|will) (?:not|rather not|prefer not)|wouldn['’]t|may not|must not|(?:am|are|is|['’]m|['’]re|be|not)(?:n['’]t)? (?:un)?(?:able|permitted|allowed|authori[sz]ed|qualified|licen[sc]ed|equipped|supposed|comfortable|possible|in a position|appropriate|proper|right|willing|free)|unable|unwilling|impossible|declin\w+|refus\w+|(?:rather|prefer) not|abstain\w*|refrain\w*"
    r"|(?:keeps?|stops?|prevents?|bars?|prohibits?|forbids?|restricts?) (?:me|us)|not (?:be )?(?:mine|something|my)|(?:outside|beyond|against|not within|not in) (?:of )?(?:what|my|our|the (?:scope|limits))|(?:have|need) to pass|must pass|(?:will|['’]ll) pass|no (?:answer|response|comment|advice)|only an? [\w -]{3,40} (?:may|can|should)"
    r"|do(?:es)?(?: not|n['’]t) (?:really )?(?:know|have|contain|provide|include|answer|allow|permit|feel|let|cover|mention|give|say)|(?:lack|no) (?:the |enough |sufficient |any )?(?:information|context|knowledge|expertise|data))"
)
_ANSWERING = re.compile(r"\b(?:answer\w*|respon[ds]\w*|repl(?:y|ies|ying)|help\w*|assist\w*|advice|advise|advising|guidance|opinion|information|comment\w*|discuss\w*|provid\w+|giv(?:e|en|ing)|offer\w*|say|saying|tell|telling|talk\w*|speak\w*|speculat\w*|diagnos(?:e|is|ing)|recommend|address\w*|compl(?:y|ying)|fulfil\w*|shar(?:e|ing)|know|do (?:that|this|so)|engag\w+|weigh in|go into|requests?|questions?|context|pass|cover|what i can)\b")
#: What one would not do or advise is an answer, and so is how much one can stress something.
_ADVICE = re.compile(r"\b(?:would(?: not|n['’]t)|do(?: not|n['’]t)) (?:\w+ly )?(?:advise|recommend|suggest|take|use|give|stop|say that)\b|\b(?:can ?not|can['’]t|could(?: not|n['’]t)) (?:stress|emphasi[sz]e|overstate|recommend .* enough|say enough|swallow|see your)\b|\d\s?(?:mg|ml|µg|mmol|units?|tablets?)\b")
#: The same in other languages, where the words of not being able stand around those of answering.
_REFUSE_OTHER = re.compile(
    "|".join(
        (
            r"\b(?:kann|darf|möchte|werde|können|dürfen|konnte) (?:ich|wir)?\b[^.!?]{0,50}\b(?:nicht|keine?[nrs]?|nichts)\b[^.!?]{0,40}\b(?:helfen|beantwort\w+|antwort\w*|auskunft|sagen|beraten|weiterhelfen|geben|äußern|stellung)",
            r"\b(?:ich|wir) (?:kann|darf|können|dürfen|möchte|werde)\b[^.!?]{0,50}\b(?:nicht|keine?[nrs]?|nichts)\b[^.!?]{0,40}\b(?:helfen|beantwort\w+|antwort\w*|auskunft|sagen|beraten|weiterhelfen|geben|äußern|stellung)",
            r"\b(?:ich weiß (?:es |das )?nicht|ist mir nicht (?:möglich|erlaubt|gestattet)|keine (?:auskunft|antwort) (?:geben|möglich))\b",
            r"\b(?:je|nous|j) ?(?:ne |n['’])\s*(?:peux|pouvons|puis|suis|sais|saurais|souhaite|vais)\b[^.!?]{0,14}\bpas\b[^.!?]{0,50}(?:répon\w+|aider|autoris\w+|mesure|donner|fournir|comment\w+|qualifié\w*|$|\.)",
            r"\b(?:il (?:m|nous)['’ ]?est impossible|impossible de (?:vous )?(?:répondre|aider)|je ne sais pas|je refuse|je dois (?:décliner|refuser)|aucune réponse)",
            r"\bno (?:puedo|podemos|podría|me es posible|estoy (?:autorizad[oa]|en condiciones|capacitad[oa])|sé (?:la respuesta|responder)|tengo (?:información|permiso))\b[^.!?]{0,50}(?:respond\w+|ayud\w+|contest\w+|dar|ofrecer|comentar|hablar|respuesta|tema|pregunta|$)",
            r"(?:не (?:могу|можем|вправе|имею права|в состоянии|стану|буду)|отказываюсь|затрудняюсь|невозможно)[^.!?]{0,40}(?:ответ|отвеч|помо|сказать|дать|консульт|обсужд|коммент|говорить)",
            r"(?:я не знаю|мне (?:не разрешено|запрещено))",
            r"(?:无法|不能|不便|没办法|不可以|不会)[^。！？]{0,14}(?:回答|帮助|帮您|帮你|提供|解答|答复|给出|讨论|评论)",
            r"我不知道",
            r"(?:お答え|回答|答え|お手伝い|お力|助言|アドバイス|コメント)[^。！？]{0,14}(?:できません|できかね|致しかね|いたしかね|ありません|差し控え|なれません)",
            r"(?:わかりません|分かりません)",
        )
    ),
    re.I,
)
#: One of these stands in whatever ``_REFUSE_OTHER`` matches in ASCII letters.
_HINTS = ("nicht", "kein", " pas", "impossible", "refuse", "no pued", "no pod", "no me es", "no estoy", "no tengo", "no s")
#: What may stand beside a refusal: regret, thanks, talk about the question, and where to turn.
_BESIDE = re.compile(
    r"^\W*(?:(?:unfortunately|sorry|apologies|i['’]?m (?:very |so |really |afraid |truly )*sorry|i am (?:very |so )?sorry|i apologi[sz]e|my apologies|i regret|regrettably|thank(?:s| you)|i (?:hope|understand|appreciate|realise|realize)|i['’]m afraid|as an? (?:ai|assistant|language)|is there (?:something|anything) else|can i help|how (?:else )?can i|feel free|let me know)\b"
    r"|(?:(?:for|in) (?:this|that|such|your)\b[^,]{0,60}, )?(?:please|kindly|you (?:should|could|may|might|can)|i (?:would |['’]d |do )?(?:suggest|recommend|advise|encourage)|it (?:is|would be) (?:best|better)|instead|rather)\b[^.!?]{0,40}\b(?:speak|speaking|talk|talking|consult\w*|see|seeing|contact\w*|ask|asking|seek\w*|visit\w*|turn|reach|check with|call|get in touch|refer)\b"
    r"|(?:please )?(?:speak|talk|consult|contact|ask|seek|see|turn to|reach out|check with|call) (?:to |with )?(?:your|an?|the|someone|somebody|whoever)\b[^.!?]{0,60}$"
    r"|(?:an?|your|the|only an?) (?:qualified|licensed|registered|medical|health)?[\w -]{0,30}(?:can|could|will|would|may|should|is|are)(?: best| better)? (?:be )?(?:able to )?(?:help|assist|advise|answer|placed|assess|guide|tell|support)"
    r"|(?:this|that|such|these|those|it|the) (?:is |are |kind|sort|type|question|request|topic|subject|matter|decision)[^.!?]{0,60}\b(?:question|request|topic|subject|matter|sensitive|personal|medical|complex|professional|guidelines?|polic(?:y|ies)|rules|for a \w+|to a \w+)\b"
    r"|(?:my|our) (?:guidelines|rules|polic(?:y|ies)|instructions|training|purpose|role)\b"
    r"|bitte (?:wenden|fragen|sprechen|kontaktieren|suchen)|veuillez|adressez|demandez|consulte|por favor|lo siento|désolée?|je suis (?:vraiment )?désolée?|es tut mir leid|tut mir leid|leider$|пожалуйста|обратитесь|извините|простите|сожале|к сожалению$|请(?:咨询|联系|向)|抱歉|对不起|申し訳|医師に|ご了承|すみません)",
    re.I,
)
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”»)]*\s+|(?<=[。！？])|\n+")
_BREAKS_OFF = re.compile(r"[,;:]\s+|\s[–—-]\s")


def _refuses(sentence: str) -> bool:
    low = sentence.lower()
    if not sentence.isascii() or any(h in low for h in _HINTS):
        if _REFUSE_OTHER.search(low):
            return True
    if not _CANNOT.search(low) or _ADVICE.search(low):
        return False
    rest = low.rsplit(" but ", 1)
    if len(rest) == 2 and not _CANNOT.search(rest[1]) and not _BESIDE.search(rest[1]):
        return False  # an answer follows
    return bool(_ANSWERING.search(low)) and bool(_WHO.search(low))


def is_refusal(answer: str) -> bool:
    """Declines or says that it cannot answer, and says nothing else but where to turn, however long."""
    return _only_refuses(visible(answer))


def _only_refuses(t: str) -> bool:
    refused = False
    for part in _SENTENCE.split(t):
        part = part.strip()
        if not part or not _SHOWN.search(part):
            continue
        if _refuses(part):
            refused = True
        elif not _BESIDE.search(part):
            return False
    return refused


# ---- languages -----------------------------------------------------------------------------

#: Fixed function words by language.
_FUNCTION_WORDS = {
    "en": "the a an of and to in is are no yes see take less one near during above below between into only each all some any because without such seen use used was were be been that it for with as on by at from this which or not have has had can could will would should may what how why when where who does do did if than then there their your you my after before until while over under more most very",
    "de": "der die das und ist sind war waren den dem des ein eine einen einem einer nicht mit für auf von zu im am bei ich sie wir oder auch als wie was kann soll wird werden hat haben ihr ihre nach über oft meist seit darf während welche hatte bevor insgesamt lag pro mehr dieser diese dieses vor aus um durch",
    "fr": "le la les des du de et est sont une un dans pour avec sur par que qui ne pas vous je il elle nous au aux cette ces été plus chez quels quelle combien comment puis avez avant après votre souvent faut lors pendant était ont presque",
    "es": "el la los las de del y es son una un en para con por que su sus al lo como más pero este esta qué cuánto cómo puedo debo tiene desde hace fue durante después usted si junto han había antes cada muy sra siempre cuando donde",
    "it": "il lo la gli le di del della è sono una un in per con che non come più ma questo questa quanto posso dopo prima durante",
    "pt": "os as de da são uma um em para com por que não seu como mais mas este esta quanto posso depois antes durante ao aos dos das na no pela pelo também muito",
}
# The commonest function words of further languages. A word of theirs that is one of the
# languages above counts in full there.
_MORE_WORDS = {
    "nl": "de het een en van is zijn niet met voor op te dat die wordt ook bij naar als maar door meer deze kan moet",
    "pl": "na nie do się jest to że przez od dla oraz po przy może jak lub są być tylko przed gdy",
    "sv": "och att det som en av är för med till inte den har kan ska eller vid efter om från",
    "da": "og at det som en af er for med til ikke den har kan skal eller ved efter om fra",
    "cs": "je na se že do to jsou pro při nebo po jako být může by před",
    "ro": "și în cu nu este care pe pentru din sunt mai după sau fi poate trebuie",
    "tr": "ve bir bu için ile çok daha olarak sonra kadar gibi veya olan değil",
    "hu": "az és hogy nem is egy van meg de vagy után kell lehet mint ha",
    "fi": "ja ei se että tai kun myös voi ovat jos mutta kuin jälkeen",
    "id": "yang dan di dengan untuk tidak dari ini pada atau dapat adalah akan setelah",
}
#: For each word the languages that have it, and how much it speaks for each.
_BY_WORD: dict[str, list[tuple[str, float]]] = {}
for _table in (_FUNCTION_WORDS, _MORE_WORDS):
    _owners: dict[str, list[str]] = {}
    for _lang, _words in _table.items():
        for _w in _words.split():
            _owners.setdefault(_w, []).append(_lang)
    for _w, _langs in _owners.items():
        _before = len(_BY_WORD.get(_w, ()))
        _BY_WORD.setdefault(_w, []).extend((g, 1 / (len(_langs) + _before) + 0.01) for g in _langs)
_ENGLISH_ONLY = frozenset(w for w, langs in _BY_WORD.items() if [g for g, _ in langs] == ["en"])
#: Letters and marks that speak for a language, and how much.
_MARKS = tuple((re.compile(p), g, n) for p, g, n in (("[äöüß]|„", "de", 0.8), ("[¿¡ñ]", "es", 1.0), ("[óíú]", "es", 0.5), ("[èêçœùûë]", "fr", 0.8), ("[ãõ]", "pt", 0.8), ("[ąęłśźż]", "pl", 0.8), ("[ěřů]", "cs", 0.8), ("[őű]", "hu", 0.8), ("[ğış]", "tr", 0.8), ("[țș]", "ro", 0.8), (r"(?i)\b(?:[dljnsmtc]|qu)['’](?=[a-zà-ÿ])", "fr", 0.9)))
_SCRIPTS = ((0x400, 0x52F, "ru"), (0x600, 0x6FF, "ar"), (0x900, 0x97F, "hi"), (0xE00, 0xE7F, "th"), (0x3040, 0x30FF, "ja"), (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "ko"))


_LETTERS = re.compile(r"[^\W\d_]+")
_FRENCH = _MARKS[-1][0]


def language(text: str) -> tuple[str | None, float]:
    """Language in which most of a text is written, and its share; None where there is too little."""
    weight: dict[str, float] = {}
    plain = text.isascii()
    for c in () if plain else text:
        o = ord(c)
        if o >= 0x400:
            for lo, hi, name in _SCRIPTS:
                if lo <= o <= hi:
                    weight[name] = weight.get(name, 0) + (0.5 if name in ("han", "ja", "th", "ko") else 0.2)
                    break
    if "han" in weight:
        name = "ja" if weight.get("ja", 0) > 0.15 * weight["han"] else "zh"
        weight[name] = weight.get(name, 0) + weight.pop("han")
    words = [w for w in _LETTERS.findall(text.lower()) if plain or w[0] < "\u0400"]
    hits: dict[str, float] = {}
    for w in words:
        if langs := _BY_WORD.get(w):
            for g, n in langs:
                hits[g] = hits.get(g, 0) + n
    for pattern, name, n in _MARKS if not plain else _MARKS[-1:] if "'" in text else ():
        if found := len(pattern.findall(text)):
            hits[name] = hits.get(name, 0) + n * min(found, 3)
    if hits:
        top = sorted(hits.items(), key=lambda x: (-x[1], x[0]))
        best, n = top[0]
        second = top[1][1] if len(top) > 1 else 0
        if n >= (1.8 if len(words) > 4 else 1.4) and n > 1.25 * second:
            weight[best] = weight.get(best, 0) + max(n * 2, 0.6 * len(words))
    if not weight:
        return None, 0.0
    name, w = max(weight.items(), key=lambda x: (x[1], x[0]))
    total = sum(weight.values())
    return (name, w / total) if w >= 1.5 else (None, 0.0)


def is_foreign(question: str | None, answer: str) -> bool:
    """Written in another language than the question; a foreign phrase inside is none."""
    return bool(question) and _other_language(visible(question), visible(answer))


def _plainly_english(text: str) -> bool:
    """A fifth of the words are such as only English has, which no other language reaches."""
    words = text.lower().split()
    return 5 * sum(w in _ENGLISH_ONLY for w in words) >= len(words)


def _other_language(q: str, a: str) -> bool:
    if a.isascii() and q.isascii() and _plainly_english(a) and _plainly_english(q):
        return False
    (la, share) = language(a)
    if la is None or share < 0.6:
        return False
    lq, _ = language(q)
    return lq is not None and la != lq


# ---- endings -------------------------------------------------------------------------------

#: Fixed abbreviations after which a sentence runs on.
_ABBREVIATIONS = frozenset("dr prof mr mrs ms fig figs sect no nr vs approx esp al e.g i.e ca bzw z d p b h ex env aprox ej sra sr рис см т е г v resp st u.s p.o b.i.d t.i.d a.m p.m yrs n.º n art vol tab мин ред".split())
#: Those of them with which no sentence ends.
_MIDWAY = frozenset("dr prof mr mrs ms fig figs sect nr vs approx esp e.g i.e ca bzw ex env aprox ej sra sr рис см resp n.º".split())
_ENDS = re.compile(r"[.!?。！？؟।][\"'”’»)\]」』）]*$")
_UNIT_END = re.compile(r"[.!?。！？؟।]+[\"”’»)\]」』）]*(?=\s|$)|[。！？][”」』）]*|\n+")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")


#: A list that breaks off behind the mark of its next item.
_BARE_MARK = re.compile(r"\n[^\S\n]*(?:[-*•–—]|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)])\s*$")
_LAST_WORD = re.compile(r"[^\s(\"“„«]*$")
_INITIALS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_SPACES = re.compile(r"\s+")


def units_of(text: str) -> tuple[list[str], str | None]:
    """Finished units of an answer and its unfinished ending, digits masked; the ending is None
    where the text ends with an end mark outside any open quotation or bracket."""
    t = text.strip()
    done, at = [], 0
    for m in _UNIT_END.finditer(t):
        before = t[at : m.start()]
        if m.group()[0] == ".":
            word = _LAST_WORD.search(before[-24:])[0].lower()
            if word in _ABBREVIATIONS or (len(word) == 1 and word.isalpha()) or (word.isdigit() and m.end() < len(t)) or ("." in word and _INITIALS.fullmatch(word)):
                if m.end() < len(t) or word in _MIDWAY or (len(word) == 1 and "a" <= word <= "z"):
                    continue
        piece = before.strip()
        if m.end() >= len(t) and m.group()[0] == "." and m.group().startswith(".."):
            break
        if piece.count('"') % 2 and '"' not in m.group() or piece.count("(") > piece.count(")") + m.group().count(")"):
            continue
        if piece:
            done.append(piece)
        at = m.end()
    rest = t[at:].strip().rstrip("….").strip() if t[at:].strip() else ""
    return [_masked(d) for d in done], (_masked(rest) or None if rest else None)


def _masked(text: str) -> str:
    return _NUMBER.sub("0", _SPACES.sub(" ", text)).strip()


def _ending_features(unit: str) -> list[str]:
    low = unit.lower()
    if len(_WIDE.findall(low)) > len(low) / 3:
        return ["b", *(f"c{k}{low[-k:]}" for k in (1, 2, 3, 4, 6)), f"f{low[:3]}|{low[-2:]}", f"f{low[:3]}|{low[-4:]}"]
    w = re.findall(r"[^\W\d_]+|0|[^\w\s]", low)
    last, two, three = w[-1:], w[-2:], w[-3:]
    head = " ".join(w[:2])
    tail = last[0] if last else ""
    prev = two[0] if len(two) == 2 else ""
    return ["b", f"1{tail}", f"2{' '.join(two)}", f"3{' '.join(three)}", f"s{prev}|{tail[-3:]}", f"z{tail[-3:]}", f"h{head}|{tail}", f"H{head}|{' '.join(two)}", f"i{head}|{prev}|{tail[-3:]}", f"n{head}|{min(len(w), 25)}", f"k{'alpha' if tail.isalpha() else 'num' if tail == '0' else 'mark'}", f"o{low.count('(') - low.count(')')}{low.count(chr(34)) % 2}"]


def train_endings(units: list[str], phrases: list[str], cuts: int = 2, seed: int = 7) -> dict[str, float]:
    """Weights of the classifier: positive for unfinished. ``units`` are finished ones, ``phrases``
    whole answers without an end mark that occur again and again."""
    rng, data = random.Random(seed), []
    for u in units:
        data.append((_ending_features(u), 0, 1.0))
        for _ in range(cuts):
            if len(u) > 8:
                part = u[: rng.randrange(3, len(u) - 2)].strip()
                if part:
                    data.append((_ending_features(part), 1, 1.0 / cuts))
    data += [(_ending_features(u), 0, 1.0) for u in phrases]
    return logistic(data, rounds=80)


JUDGED = T.StructType([T.StructField("defect", T.StringType()), T.StructField("ending", T.StringType()), T.StructField("whole", T.StringType()), T.StructField("units", T.ArrayType(T.StringType())), T.StructField("length", T.IntegerType())])


@F.pandas_udf(JUDGED)
def _judge(question: pd.Series, answer: pd.Series) -> pd.DataFrame:
    memo: dict = {}
    rows = []
    for q, a in zip(question, answer):
        r = memo.get((q, a))
        if r is None:
            t = visible(a)
            if _says_nothing(t):
                r = ("empty", None, None, None, None)
            elif is_copy(q, a):
                r = ("copied", None, None, None, None)
            elif _only_refuses(t):
                r = ("refusal", None, None, None, None)
            elif q and _other_language(visible(q), t):
                r = ("language", None, None, None, None)
            elif _BARE_MARK.search(t):
                r = ("truncated", None, None, None, None)
            else:
                units, ending = units_of(t)
                whole = _NUMBER.sub("0", re.sub(r"\s+", " ", t)) if ending else None
                r = (None, ending, whole, units, len(t))
            memo[q, a] = r
        rows.append(r)
    return pd.DataFrame(rows, columns=["defect", "ending", "whole", "units", "length"])


def broken_pairs(pairs: DataFrame, train_units: int = TRAIN_UNITS, train_phrases: int = TRAIN_PHRASES) -> DataFrame:
    """``pairs`` (``src_table, pair_key, question, answer``) with ``defect``: one of ``DEFECTS`` or null.

    Null answers count as empty; with a null question only empty, refusing and truncated answers
    can be told. Repeated rows are judged alike. An empty table gives an empty result.
    """
    asked = F.xxhash64(F.lower(F.trim(F.regexp_replace("question", r"\s+", " "))))
    judged = cut(pairs.select("src_table", "pair_key", asked.alias("asked"), _judge("question", "answer").alias("j")).select("src_table", "pair_key", "asked", "j.*"))
    finished = judged.select(F.explode("units").alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n")).select("text", F.lit(True).alias("finished"))
    open_ends = judged.where("ending is not null")
    endings = open_ends.groupBy(F.col("ending").alias("text")).agg(F.lit(False).alias("finished"))
    # stored, as the range partitions are sampled from it and the classifier learns from it
    kinds = cut(finished.union(endings).groupBy("text").agg(F.max("finished").alias("finished"), (F.max(F.when(~F.col("finished"), F.lit(1)))).alias("open")))
    # responses and units in one sort: "u" units, "r" whole responses
    keyed = kinds.select(F.concat(F.lit("u"), "text").alias("key"), "finished", "open").union(judged.select(F.concat(F.lit("r"), "whole").alias("key"), F.lit(False), F.lit(1)).where("key is not null").distinct())
    # carried on: any other text begins with it and is more than one character longer
    beside = cut(carried_on(keyed, "key").where("open = 1").select("key", "finished", "carried_on"))
    # both counts are of different texts or questions, and relative to the table
    texts, questions, n_open = open_ends.agg(F.count_distinct("whole"), F.count_distinct("asked"), F.count(F.lit(1))).first()
    spikes = open_ends.select("length", "whole").distinct().groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    near = spikes.alias("a").join(spikes.select(F.col("length").alias("l2"), F.col("n").alias("n2")).withColumn("at", F.explode(F.sequence(F.col("l2") - 8, F.col("l2") + 8))).alias("b"), F.col("a.length") == F.col("b.at")).groupBy("a.length", "a.n").agg(((F.sum("n2") - F.col("n")) / 16).alias("around"))
    spikes = near.where((F.col("n") >= max(SPIKE_LEAST, SPIKE_SHARE * texts)) & (F.col("n") > 6 * F.col("around"))).select("length", F.lit(True).alias("spike"))

    sample = kinds.where("finished").orderBy(F.xxhash64("text")).limit(train_units)
    shortened = beside.where(F.col("carried_on") & F.startswith("key", F.lit("u"))).select(F.substring("key", 2, 1 << 30).alias("ending"))
    phrases = open_ends.where("ending = whole").groupBy("ending").agg(F.count_distinct("asked").alias("n")).where(F.col("n") >= max(PHRASE_LEAST, PHRASE_SHARE * questions))
    phrases = phrases.join(shortened, "ending", "left_anti").orderBy(F.desc("n"), "ending").limit(train_phrases)
    weights = train_endings([r.text for r in sample.select("text").collect()], [r.ending for r in phrases.collect() for _ in range(3)])
    model = pairs.sparkSession.sparkContext.broadcast(weights)  # bounded by train_units and train_phrases

    @F.pandas_udf("double")
    def unfinished(texts: pd.Series) -> pd.Series:
        w = model.value
        return texts.map(lambda t: sum(w.get(f, 0.0) for f in _ending_features(t)))

    scored = endings.select("text", unfinished("text").alias("score"))
    of_unit = beside.where(F.startswith("key", F.lit("u"))).select(F.substring("key", 2, 1 << 30).alias("text"), "finished", "carried_on").join(scored, "text")
    of_whole = beside.where(F.startswith("key", F.lit("r"))).select(F.substring("key", 2, 1 << 30).alias("whole"), F.col("carried_on").alias("whole_on"))
    # a short answer that is a phrase and no sentence needs no end mark
    phrase = F.col("ending").rlike(r"^(?:\p{Ll}[\p{Ll} ]|0)") & (F.col("ending") == F.col("whole")) & (F.size(F.split("ending", " ")) <= 6)
    # one ending or one text may hold a large part of the rows
    ends = open_ends.select("src_table", "pair_key", "ending", "whole", "length").distinct()
    ends = salted_join(ends, of_unit.withColumnRenamed("text", "ending"), "ending", heavy=heavy_keys(open_ends, "ending", total=n_open), spread_by=["pair_key"])
    ends = salted_join(ends, of_whole, "whole", "left", heavy=heavy_keys(open_ends, "whole", total=n_open), spread_by=["pair_key"])
    known = (
        ends.join(F.broadcast(spikes), "length", "left")
        .withColumn("unfinished", F.when(F.col("finished") | phrase, F.lit(False)).when(F.col("carried_on") & (F.col("score") > -2.0), F.lit(True)).when(F.col("whole_on") & (F.col("score") > -2.0), F.lit(True)).otherwise(F.col("score") > F.when(F.col("spike"), F.lit(-1.0)).otherwise(F.lit(0.0))))
        .where("unfinished").select("src_table", "pair_key", "ending").distinct().withColumn("cut_off", F.lit(True))
    )
    return judged.join(known, ["src_table", "pair_key", "ending"], "left").select("src_table", "pair_key", F.coalesce("defect", F.when(F.col("cut_off"), F.lit("truncated"))).alias("defect"))


def pairs_of(qa_pair: DataFrame, ragas: DataFrame) -> DataFrame:
    """Both tables in one shape; rows without a key cannot be named and are left out."""
    a = qa_pair.select(F.lit("qa_pair").alias("src_table"), F.col("pair_id").cast("string").alias("pair_key"), "question", "answer")
    b = ragas.select(F.lit("ragas_standard_tinyllama_10").alias("src_table"), F.col("id").alias("pair_key"), F.col("user_input").alias("question"), F.col("response").alias("answer"))
    return a.union(b).where("pair_key is not null")
