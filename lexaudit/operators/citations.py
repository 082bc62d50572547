"""Citations of one text, read word by word.

Numbered citations are read outwards from their digits: forwards to the end of
the number, backwards over the words of the name. The other forms are read
forwards from the word that opens them. Readers take a text and a place and
return the place behind what they have read, or NONE; ``ends`` readers return
every place that may follow, the furthest first. No reader looks further than
what it may take, so that time follows the length of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator
from functools import lru_cache
from itertools import product

# ---- Fixed values ----
CONNECTORS = frozenset("em no na nos nas de da do das dos e".split())
#: Words that open a sentence before a name, besides articles, verbs with a pronoun and adverbs in -mente.
OPENERS = frozenset(
    "Também Tambem Ainda Assim Ademais Outrossim Contudo Todavia Entretanto Porém Porem Portanto Logo Destarte Conforme Consoante Segundo Vide Cf "
    "Como Quando Embora Conquanto Apesar Sobre Quanto Acerca Nesse Neste Naquele Nessa Nesta Daquele Desse Deste Além Alem Alís Alis Aliás Alias".split()
)
ARTICLES = frozenset("A As O Os".split())
PRONOUNS = frozenset("se o a os as lhe lhes nos".split())
#: Letters that scanning puts for digits.
SCANNED = frozenset("OolIGgSs")
INSIDE_NUMBER = frozenset(".-/:°ºnN() \n\xa0")
#: Labels of numbers that name no case; those in lower case may be capitalised.
LABELS = (
    "CNPJ CPF RG PIS PASEP CEP NIT CTPS OAB DJ DJe DJE DEJT DOU DOE LEXSTJ RTJ RSTJ ID EC MP PL PEC".split()
    + "protocolo matrícula inscrição portaria decreto resolução ofício circular edital contrato apólice boleto".split()
    + "evento seq fl fls folha folhas anexo doc mov pág página sessão publicado publicada autuado autuada desconto acréscimo redução alíquota".split()
    + "honorários custas juros multa correção item cláusula volume tomo capítulo".split()
    + ["instrução normativa", "nota técnica", "nota fiscal", "julgado em", "julgada em", "emenda constitucional", "medida provisória", "projeto de lei"]
)
#: How far before a number its label may stand.
LABEL_REACH = 24
NOUNS = (
    "julgado julgada julgados julgadas precedente precedentes acórdão acórdãos decisão decisões aresto arestos entendimento entendimentos jurisprudência".split()
    + ["orientação jurisprudencial"]
)
KINDS = frozenset(
    "Reclamação Rcl APL Apelação AgRg AgInt AgR EDcl ED RHC RMS ROMS HC MS RE REsp AREsp ARE RR AIRR ARR RSE RO ROC "
    "ADI ADC ADPF ADO CC Pet AC AI SL SS QO EREsp EDiv Agravo Recurso Petição Suspensão".split()
    + ["Habeas Corpus", "Mandado de Segurança", "Ação Direta", "Ação Declaratória", "Ação Rescisória", "Conflito de Competência"]
)
#: Kinds that further words may follow, and how many.
LONG_KINDS = {"Agravo": 4, "Recurso": 4, "Suspensão": 4, "Ação Direta": 3, "Ação Declaratória": 3, "Ação Rescisória": 3}
SUPERIOR = (
    "Supremo Tribunal Federal", "Superior Tribunal de Justiça", "Tribunal Superior do Trabalho", "Tribunal Superior Eleitoral", "Superior Tribunal Militar",
    "STF", "STJ", "TST", "TSE", "STM",
)
REGIONAL = ("Tribunal Regional Federal", "Tribunal Regional do Trabalho", "Tribunal Regional Eleitoral")
STATE = "Tribunal de Justiça"
ORDINALS = frozenset("Primeira Segunda Terceira Quarta Quinta Sexta Sétima Oitava".split())
CHAMBERS = frozenset("Turma Seção Câmara".split())
PLENARY = ("Corte Especial", "Tribunal Pleno", "Órgão Especial")
QUALIFIERS = "reiterad iterativ notóri pacífic remans".split()
TITLES = frozenset("Min Ministro Ministra Des Desembargador Desembargadora".split())
# ---- End of fixed values ----

NONE = -1
#: Scanning loses accents and cedillas of these letters.
PLAIN = str.maketrans("áâãéêíóôõúçÁÂÃÉÊÍÓÔÕÚÇ", "aaaeeiooouc" + "aaaeeiooouc".upper())


def spellings(words: Collection[str]) -> frozenset[str]:
    """The words, and each without its accents."""
    return frozenset(words) | {w.translate(PLAIN) for w in words}


_LABELS = spellings([" ".join(w) for label in LABELS for w in product(*({x, x if x in ("de", "em") else x[:1].upper() + x[1:]} for x in label.split()))])
_KINDS = {k: LONG_KINDS.get(w, 0) for w in KINDS for k in spellings([w])}
_NOUNS, _CHAMBERS, _PLENARY = spellings(NOUNS), spellings(CHAMBERS), spellings(PLENARY)
_ORDINALS, _REGION = spellings(ORDINALS), spellings(["Região"])
_STATE, _SUPERIOR = spellings([STATE]), spellings(SUPERIOR)
_QUALIFIERS = spellings([stem + gender + many for stem in QUALIFIERS for gender in "oa" for many in ("", "s")])
OF, OF_THE = frozenset(("dc", "de", "do")), frozenset(("do", "da"))
LINKS = frozenset(w + s for w in ("do", "da", "de", "ds", "pelo", "pela") for s in ("", "s"))
#: Openings begin with a literal or a class, so that a search skips to the letters that may begin one; where a word must begin is looked at behind it.
_ANCHOR = {name: re.compile("|".join(sorted(words, key=len, reverse=True))) for name, words in (("noun", {w.split()[0] for w in _NOUNS}), ("kind", {w.split()[0] for w in _KINDS}))}
_DIGITS, _ARTICLE, _TOPIC, _SUMMARY = re.compile(r"\d+"), re.compile("[Aa]rt"), re.compile("[tT][eE][mM][aãáàAÃÁÀ]"), re.compile("[sS5\u017f][uúUÚ][mM]")
_WORD, _BLANKS, _LETTERS, _SMALL = (re.compile(p).match for p in (r"\w*", r"\s*", "[A-Za-zÀ-ÿ]*", ".[a-zà-ÿ]+$"))
#: Characters that a word of a name has.
_IN_NAME = frozenset(chr(c) for c in range(0x100) if re.match("[A-Za-zÀ-ÿ.-]", chr(c)))
#: Whoever wrote for the court is named behind a word that holds one of these (see rapporteur).
WRITERS = ("Rel", "relat", "lavra")


# ---- Characters and words ----


def capital(c: str) -> bool:
    return "A" <= c <= "Z" or "À" <= c <= "Ý"


def small(c: str) -> bool:
    return "a" <= c <= "z" or "à" <= c <= "ÿ"


def letter(c: str) -> bool:
    return "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ"


def blanks(t: str, at: int) -> int:
    """Behind any white space."""
    return _BLANKS(t, at).end() if t[at : at + 1].isspace() else at


def gap(t: str, at: int) -> int:
    """Behind white space, of which there must be some."""
    end = blanks(t, at)
    return end if end > at else NONE


def loose(t: str, at: int) -> int:
    """Behind any white space and commas."""
    while at < len(t) and (t[at] == "," or t[at].isspace()):
        at += 1
    return at


def word(t: str, at: int) -> int:
    """Behind a word of letters, digits and underscores; at itself if there is none."""
    return _WORD(t, at).end() if at < len(t) else at


def run(t: str, at: int, kind: Callable[[str], bool], most: int = 1 << 30) -> int:
    """Behind a run of characters of a kind."""
    end = min(len(t), at + most)
    while at < end and kind(t[at]):
        at += 1
    return at


def named(t: str, at: int, words: Collection[str]) -> int:
    """Behind a whole word of the given ones."""
    end = word(t, at)
    return end if end > at and t[at:end] in words else NONE


def phrase(t: str, at: int, phrases: Collection[str], most: int = 4) -> list[int]:
    """Ends of those of the phrases, of one to most words, that stand here, the longest first."""
    ends, end, said = [], at, []
    for _ in range(most):
        stop = word(t, end)
        if stop == end:
            break
        said.append(t[end:stop])
        if " ".join(said) in phrases:
            ends.append(stop)
        end = blanks(t, stop)
        if end == stop:
            break
    return ends[::-1]


def then(t: str, at: int, *steps: Callable[[str, int], int]) -> int:
    """Behind all steps, one after the other."""
    for step in steps:
        if at == NONE:
            return NONE
        at = step(t, at)
    return at


def either(words: Collection[str]) -> Callable[[str, int], int]:
    return lambda t, at: named(t, at, words)


# ---- Numbered cases ----


def number_end(t: str, at: int) -> int:
    """Behind a case number that starts here: two characters at least, a digit or a digit's stand-in at its end."""
    end, i = NONE, at + 1
    while i < len(t):
        c = t[i]
        if c in "0123456789" or c.isdigit():
            end = i + 1
        elif c in SCANNED:
            if t[i - 1].isdigit() and not (i + 1 < len(t) and letter(t[i + 1])):
                end = i + 1
            ahead = run(t, i + 1, lambda x: x in ".-")
            if not (ahead < len(t) and t[ahead].isdigit()):
                break
        elif c not in INSIDE_NUMBER:
            break
        i += 1
    return end


def opens_sentence(t: str, at: int) -> bool:
    """Whether the capitalised word here leads up to a name and is no part of it."""
    end = _LETTERS(t, at).end()
    if end < len(t) and (t[end].isalnum() or t[end] == "_"):
        return t[at:end] == "N" and t[end] in "º°" and word(t, end + 1) == end + 1
    said = t[at:end]
    if said in ARTICLES or said in OPENERS or (said == "N" and t[end : end + 1] == "°"):
        return True
    if said.endswith("mente") and len(said) > 6 and _SMALL(said):
        return True
    return t[end : end + 1] == "-" and bool(_SMALL(said)) and t[end + 1 : word(t, end + 1)] in PRONOUNS


def name_start(t: str, end: int, low: int, most: int = 13) -> int:
    """Where the name that ends here starts: up to most words, capitalised ones and connectors; not before low."""
    best = NONE
    for _ in range(most):
        begin = end
        while begin > low and t[begin - 1] in _IN_NAME:
            begin -= 1
        if begin == end:
            break
        bounded = begin == low or t[begin - 1].isspace()
        if bounded and capital(t[begin]) and not opens_sentence(t, begin):
            best = begin
        elif not (bounded and t[begin:end] in CONNECTORS):
            inner = (i for i in range(begin, end) if capital(t[i]) and not opens_sentence(t, i))
            return next(inner, best)
        end = begin
        while end > low and t[end - 1].isspace():
            end -= 1
        if end == begin:
            break
    return best


def _before_blanks(t: str, at: int, low: int) -> int:
    while at > low and (t[at - 1] == " " or t[at - 1].isspace()):
        at -= 1
    return at


def _before_mark(t: str, at: int, low: int, signs: str = "nN") -> int:
    """Before a number mark (n and a sign) that ends here, after white space or not."""
    end = _before_blanks(t, at, low)
    return end - 2 if end - 2 >= low and t[end - 1] in "º°o." and t[end - 2] in signs else NONE


def case_start(t: str, at: int, low: int) -> int:
    """Where the citation whose number starts here starts: its name, and the word for a docket before it."""
    start = name_start(t, _before_blanks(t, at, low), low)
    marked = _before_mark(t, at, low)
    if marked != NONE:
        other = name_start(t, _before_blanks(t, marked, low), low)
        start = other if start == NONE or NONE < other < start else start
    if start == NONE:
        return NONE
    for end in (start, _before_mark(t, start, low, "n")):
        stop = _before_blanks(t, end, low)
        if end == NONE or stop == end:
            continue
        begin = stop
        while begin > low and letter(t[begin - 1]):
            begin -= 1
        if t[begin:stop].lower() in ("processo", "processos", "autos") and t[begin + 1 : stop].islower():
            return begin
    return start


def numbered(t: str) -> Iterator[tuple[int, int]]:
    """Cases by name and number, with the state behind it."""
    low = 0
    for digits in _DIGITS.finditer(t):
        first = digits.start()
        if first < low:
            continue
        lead = first
        while lead > low and (t[lead - 1] in SCANNED or t[lead - 1] in ".-"):
            lead -= 1
        tries = [first]
        if lead < first:
            seen = first
            found = 0
            while seen < len(t) and found < 2 and (t[seen].isdigit() or t[seen] in SCANNED or t[seen] in ".-"):
                found += t[seen].isdigit()
                seen += 1
            if found == 2:
                tries = [i for i in range(lead, first) if t[i] in SCANNED and (i == 0 or not letter(t[i - 1]))][:2] + tries
        for at in tries:
            start = case_start(t, at, low)
            end = number_end(t, at) if start != NONE else NONE
            if end == NONE:
                continue
            state = blanks(t, end)
            if t[state : state + 1] in ("-", "/", "–", "("):
                state = blanks(t, state + 1)
                if run(t, state, lambda c: "A" <= c <= "Z", 2) == state + 2:
                    end = state + 2 + (t[state + 2 : state + 3] == ")")
            yield start, end
            low = end
            break


# ---- Summaries, topics, articles ----


def grouped(t: str, at: int) -> int:
    """Behind a number in groups of three digits, with a dot or a space between."""
    end = run(t, at, str.isdigit, 3)
    if end == at:
        return NONE
    while t[end : end + 1] in (".", " ") and run(t, end + 1, str.isdigit, 3) == end + 4:
        end += 4
    return end


def summary(t: str, at: int) -> int:
    end = at + 3
    if t[end : end + 3].lower() == "ula":
        end += 3
    end += t[end : end + 1] == "."
    more = gap(t, end)
    if more != NONE and t[more : more + 10].lower() == "vinculante":
        end = more + 10
    digits = gap(t, end)
    if digits == NONE or (end := run(t, digits, str.isdigit)) == digits:
        return NONE
    court = then(t, end, gap, lambda t, i: i + 2 if t[i : i + 2].lower() in OF_THE else NONE, gap)
    last = run(t, court, letter) if court != NONE else court
    return last if last > court else end


def topic(t: str, at: int) -> int:
    end = then(t, at + 4, gap, grouped)
    if end == NONE:
        return NONE
    tail = then(t, end, gap, lambda t, i: word(t, i) if t[i : word(t, i)].lower() in ("do", "da", "dos", "das") else NONE, gap)
    if tail != NONE:
        first = word(t, tail)
        second = gap(t, first)
        if second != NONE:
            pair = (t[tail:first].lower().translate(PLAIN), t[second : word(t, second)].lower())
            if pair == ("repercussao", "geral") or (pair[0] in ("recurso", "recursos") and pair[1] in ("repetitivo", "repetitivos")):
                return word(t, second)
    return end


def _item(t: str, at: int) -> int:
    """Behind one item of an article: a Roman number, a letter, a quoted letter or a paragraph."""
    c = t[at : at + 1]
    if c in ("'", '"') and at + 2 < len(t) and "a" <= t[at + 1] <= "z" and t[at + 2] == c:
        return at + 3
    if c == "§":
        digits = blanks(t, at + 1)
        end = run(t, digits, str.isdigit)
        if end == digits:
            return NONE
        end += t[end : end + 1] in ("º", "°")
        return end + 2 if t[end : end + 1] == "-" and "A" <= t[end + 1 : end + 2] <= "Z" else end
    end = run(t, at, lambda x: x in "IVXLC")
    if end == at and "a" <= c <= "z":
        end = at + 1
    return end if end > at and word(t, end) == end else NONE


def _code(t: str, at: int) -> int:
    """Behind the name of a code and its number."""
    end = run(t, at, capital)
    if end < at + 2:
        if end == at or (end := run(t, at + 1, small)) == at + 1:
            return NONE
        dash = blanks(t, end)
        second = blanks(t, dash + 1) if t[dash : dash + 1] == "-" else len(t)
        if second < len(t) and letter(t[second]) and (stop := run(t, second + 1, small)) > second + 1:
            end = stop
        for _ in range(5):
            begin = gap(t, end)
            if begin == NONE:
                break
            stop = word(t, begin)
            said = t[begin:stop]
            if not (said in ("da", "de", "do", "das", "des", "dos", "e") or (len(said) > 1 and capital(said[0]) and all(map(small, said[1:])))):
                break
            end = stop
    begin = blanks(t, end)
    if t[begin : begin + 1] == "-":
        begin = blanks(t, begin + 1)
    elif t[begin : begin + 1] == "n":
        begin += 1
        for sign in (".", "º°o", "."):
            begin += t[begin : begin + 1] in tuple(sign)
        begin = blanks(t, begin)
    elif begin == end:
        return end
    stop = run(t, begin, lambda c: c.isdigit() or c in "./-") if t[begin : begin + 1].isdigit() else begin
    while stop > begin and not t[stop - 1].isdigit():
        stop -= 1
    return stop if stop > begin + 1 else end


def article(t: str, at: int) -> int:
    end = at + 3
    if t.startswith("igo", end):
        end += 3
    end += t[end : end + 1] == "."
    end = grouped(t, blanks(t, end))
    if end == NONE:
        return NONE
    end += t[end : end + 1] in ("º", "°")
    comma = blanks(t, end)
    while t[comma : comma + 1] == "," and (more := _item(t, blanks(t, comma + 1))) != NONE:
        comma = blanks(t, more)
    comma += t[comma : comma + 1] == ","
    return then(t, blanks(t, comma), either(("da", "de", "do", "das", "des", "dos")), gap, _code)


def begins_word(t: str, at: int) -> bool:
    """Whether no letter, digit or underscore stands before."""
    return at == 0 or not (t[at - 1].isalnum() or t[at - 1] == "_")


def forward(t: str, opening: re.Pattern, read: Callable[[str, int], int], whole: bool = True, stop: int | None = None) -> Iterator[tuple[int, int]]:
    """What read finds from each opening on that begins a word (or, if not whole, stands anywhere) before stop, without overlaps."""
    low = 0
    for m in opening.finditer(t):
        if stop is not None and m.start() >= stop:
            break
        if m.start() >= low and (not whole or begins_word(t, m.start())) and (end := read(t, m.start())) != NONE:
            yield m.start(), end
            low = end


# ---- Cases that are described ----


def _region(t: str, at: int) -> int:
    def ordinal(t: str, i: int) -> int:
        end = run(t, i, lambda c: "0" <= c <= "9", 2)
        return NONE if end == i else end + (t[end : end + 1] in ("ª", "a"))

    return then(t, at, gap, either(("da", "de")), gap, ordinal, gap, either(_REGION))


def court_ends(t: str, at: int) -> list[int]:
    """Ends of the court's name that starts here."""
    end = word(t, at)
    said, ends = t[at:end], phrase(t, at, _SUPERIOR) + phrase(t, at, REGIONAL)
    if ends:
        return [e for e in (_region(t, ends[0]), ends[0]) if e != NONE]
    if said.startswith("TJ") and len(said) == 4 and all("A" <= c <= "Z" for c in said[2:]):
        return [end]
    digits = {"TRF": 1, "TRT": 2}.get(said[:3], 0)
    if digits and said[3:].isdigit() | (len(said) == 3) and len(said) <= 3 + digits:
        spaced = run(t, end + 1, str.isdigit, digits) if len(said) == 3 and t[end : end + 1].isspace() else end
        return [e for e in (_region(t, end), spaced if word(t, spaced) == spaced else end, end) if e != NONE]
    if said == "TRE":
        state = end + 1 if t[end : end + 1] == "-" or t[end : end + 1].isspace() else end
        stop = run(t, state, lambda c: "A" <= c <= "Z", 2)
        return [e for e in (_region(t, end), stop if stop == state + 2 and word(t, stop) == stop else NONE) if e != NONE]
    if len(said) == 5 and said.startswith("TRE") and all("A" <= c <= "Z" for c in said):
        return [end]
    ends = phrase(t, at, _STATE)[:1]
    for _ in range(3 if ends else 0):
        place = then(t, ends[-1], gap, either(("de", "do")), gap)
        if place == NONE or not (place < len(t) and capital(t[place])):
            break
        ends.append(word(t, place))
    return ends[::-1]


def _panel(t: str, at: int) -> int:
    """Behind a panel of a court and the word that links it."""
    whole = phrase(t, at, _PLENARY)
    if whole:
        return then(t, whole[0], gap, either(OF_THE), gap)
    end = word(t, at)
    said = t[at:end]
    if said not in _ORDINALS and not (len(said) == 2 and said[0].isdigit() and said[1] == "ª"):
        return NONE
    return then(t, end, gap, either(_CHAMBERS), gap, either(OF_THE), gap)


def seated(t: str, at: int) -> list[int]:
    """Ends of a court, with a panel of it before it or not."""
    inner = _panel(t, at)
    return court_ends(t, inner) if inner != NONE else court_ends(t, at)


def year(t: str, at: int, words: Collection[str] = OF | {"em"}) -> int:
    """Behind a word like em or de and a year."""
    if t[at : at + 2] not in words:
        return NONE
    at = blanks(t, at + 2)
    return at + 4 if t[at : at + 2] in ("19", "20") and run(t, at, str.isdigit, 4) == at + 4 else NONE


def dated(t: str, at: int) -> int:
    """Behind a date, with a participle before it or not."""
    at = loose(t, at)
    after = gap(t, word(t, at)) if word(t, at) > at else NONE
    late = year(t, after) if after != NONE else NONE
    return late if late != NONE else year(t, at)


def _part(t: str, at: int) -> int:
    """Behind one part of a person's name; a dot belongs to a short part that a capital follows."""
    if not (at < len(t) and capital(t[at])):
        return NONE
    end = word(t, at)
    if t[end : end + 1] == "." and end - at <= 3:
        after = blanks(t, end + 1)
        if after < len(t) and capital(t[after]):
            return end + 1
    return end


def person(t: str, at: int) -> int:
    """Behind a name, with the title before it or not."""
    title = named(t, at, TITLES)
    if title != NONE:
        title += t[title : title + 1] == "."
        if (end := person_name(t, blanks(t, title))) != NONE:
            return end
    return person_name(t, at)


def person_name(t: str, at: int) -> int:
    end = _part(t, at)
    for _ in range(5 if end != NONE else 0):
        begin = gap(t, end)
        more = NONE if begin == NONE else _part(t, begin)
        if more == NONE and begin != NONE:
            more = named(t, begin, ("da", "de", "do", "das", "des", "dos", "e"))
        if more == NONE:
            break
        end = more
    return end


def rapporteur(t: str, at: int) -> int:
    """Behind the words that say who wrote for the court."""
    at = loose(t, at)
    end = word(t, at)
    said = t[at:end]
    if said in ("Rel", "Relator", "Relatora", "Relatr", "Relatra"):
        end += t[end : end + 1] == "."
        return person(t, blanks(t, end))
    if said in ("relatado", "relatada"):
        return then(t, end, gap, either(("pelo", "pela")), gap, person)
    if said in ("pela", "sob", "da") or said in OF:
        end = then(t, end, gap, either(("relatoria", "lavra")), gap)
        if end == NONE:
            return NONE
        of = named(t, end, OF | OF_THE)
        return person(t, end if of == NONE else blanks(t, of))
    return NONE


def by_court(t: str, at: int) -> int:
    """A ruling by court, and by date or rapporteur or both."""
    for noun in phrase(t, at, _NOUNS, 2):
        begin = gap(t, noun)
        if begin == NONE:
            continue
        stop = word(t, begin)
        said = t[begin:stop]
        linked = len(said) > 3 and said not in LINKS and all(map(small, said)) and said.rstrip("s")[-1:] in ("o", "a")
        for link in ([gap(t, stop)] if linked else []) + [begin]:
            inner = NONE if link == NONE else then(t, link, either(LINKS), gap)
            for court in seated(t, inner) if inner != NONE else ():
                when = dated(t, court)
                who = rapporteur(t, court if when == NONE else when)
                if who != NONE or when != NONE:
                    return max(who, when)
    return NONE


def _kind_ends(t: str, at: int) -> list[int]:
    """Ends of the kind of appeal that starts here, with the words that may follow it."""
    found = phrase(t, at, _KINDS, 3)
    if not found:
        return []
    ends = [found[0]]
    for _ in range(_KINDS[" ".join(t[at : found[0]].split())]):
        begin = gap(t, ends[-1])
        if begin == NONE or word(t, begin) == begin:
            break
        ends.append(word(t, begin))
    return ends[::-1]


def by_kind_and_court(t: str, at: int) -> int:
    """An appeal by kind, court, date and rapporteur."""
    for kind in _kind_ends(t, at):
        inner = then(t, kind, gap, either(OF_THE), gap)
        for court in seated(t, inner) if inner != NONE else ():
            who = then(t, court, dated, rapporteur)
            if who != NONE:
                return who
    return NONE


def by_kind_and_year(t: str, at: int) -> int:
    """An appeal by kind, year and rapporteur."""
    return next((who for kind in _kind_ends(t, at) if (who := then(t, kind, gap, year, rapporteur)) != NONE), NONE)


def appeals(t: str, read: Callable[[str, int], int]) -> Iterator[tuple[int, int]]:
    """Appeals by kind that read finds: they end in who wrote for the court, so that none begins behind the last such word."""
    return forward(t, _ANCHOR["kind"], read, stop=max(map(t.rfind, WRITERS)))


def rulings(t: str) -> Iterator[tuple[int, int]]:
    """Rulings by court, from the adjective before the noun on."""
    low = 0
    for start, end in forward(t, _ANCHOR["noun"], by_court):
        stop = _before_blanks(t, start, low)
        begin = stop
        while begin > low and letter(t[begin - 1]):
            begin -= 1
        bounded = begin == 0 or not (t[begin - 1].isalnum() or t[begin - 1] == "_")
        yield (begin if stop < start and bounded and t[begin:stop] in _QUALIFIERS else start), end
        low = end


# ---- Numbers that name no case ----


@lru_cache(1 << 14)
def ends_in_label(before: str) -> bool:
    """Whether a label stands at the end, with nothing but marks, n, de and em behind it."""
    end = len(before)
    while end:
        c = before[end - 1]
        if not (c.isalnum() or c == "_"):
            if not (c.isspace() or c in "/º°.:-"):
                return False
            end -= 1
            continue
        if c.isdigit():  # no label has a digit
            return False
        said: list[str] = []
        stop = end
        while len(said) < 3 and stop:
            begin = stop
            while begin and (before[begin - 1].isalnum() or before[begin - 1] == "_") and before[begin - 1] not in "º":
                begin -= 1
            if begin == stop:
                break
            said.insert(0, before[begin:stop])
            if " ".join(said) in _LABELS:
                return True
            stop = begin
            while stop and before[stop - 1].isspace():
                stop -= 1
            if stop == begin:
                break
        last = said[-1] if said else before[end - 1]
        if last not in ("de", "em", "º") and last.strip("nN"):
            return False
        end -= len(last)
    return False


def is_quantity(snippet: str) -> bool:
    """Whether the snippet ends with de or em and a plain number."""
    parts = snippet.rsplit(None, 1)
    return len(parts) == 2 and parts[1].isdigit() and re.split(r"\W+", parts[0])[-1].lower() in ("de", "em")


def is_case(t: str, start: int, end: int, quantity: bool = True, label: bool = True) -> bool:
    """Whether a numbered span names a case or a provision, and no quantity or administrative number."""
    snippet = t[start:end]
    if quantity and is_quantity(snippet):
        return False
    opening = snippet[: word(snippet, 0)]
    if not label or opening.lower() in ("art", "artigo") and opening[1:].islower():
        return True
    if ends_in_label(t[max(0, start - LABEL_REACH) : start]):
        return False
    for m in _DIGITS.finditer(snippet):
        at = m.start()
        further = at > 1 and snippet[at - 1] in "./-" and snippet[at - 2].isdigit()  # no label has a digit
        if not further and ends_in_label(snippet[max(0, at - LABEL_REACH) : at]):
            return False
    return True


#: Forms by name, in the order in which they are read; those of NUMBERED are filtered by what their number stands for.
FORMS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "numbered": numbered,
    "summary": lambda t: forward(t, _SUMMARY, summary, whole=False),
    "article": lambda t: forward(t, _ARTICLE, article),
    "topic": lambda t: forward(t, _TOPIC, topic),
    "ruling": rulings,
    "kind_court": lambda t: appeals(t, by_kind_and_court),
    "kind_year": lambda t: appeals(t, by_kind_and_year),
}
NUMBERED = frozenset(("numbered", "summary", "article", "topic"))


def spans(t: str, forms: Collection[str] = tuple(FORMS), quantity: bool = True, label: bool = True) -> Iterator[tuple[int, int]]:
    """Every citation of a text, form by form; spans may overlap."""
    for name, read in FORMS.items():
        if name in forms:
            yield from (s for s in read(t) if name not in NUMBERED or is_case(t, *s, quantity, label))
