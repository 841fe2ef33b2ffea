"""Personal information in free text: found, and replaced by typed, linked placeholders.

Patterns run once over all texts of a batch, joined by a character no pattern matches; offsets
tell which text a hit is in. What is found is replaced by ``<KIND:pseudonym>``. Numbers and dates
are permuted within their own format by a keyed Feistel network (see ``numbers``): separators,
prefixes and letters' places stay, valid numbers become valid ones, and equal values get equal
pseudonyms in all documents, whatever their spacing or, for phones, their country code.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwake.llm import codepoints as C
from loomwake.llm import numbers as N

KINDS = ("email", "phone", "id_number", "address", "name")
#: Kind of what is replaced but no kind of personal information here: dates of birth.
BIRTH = "birth_date"
GAP = "\x00"
#: Most characters of an e-mail address before and behind its sign, and of what stands before a street word or a verb.
LOCAL, DOMAIN, REACH = 64, 255, 200


@lru_cache(100_000)
def pseudonym(kind: str, value: str, key: bytes) -> str:
    """What stands for ``value``: numbers and dates in their own format, other values as a keyed tag."""
    if kind == "phone":
        return N.permute_phone(value, key)
    if kind == "id_number":
        return N.permute_identity(value, key)
    if kind == BIRTH:
        return _birth(value, key)
    plain = " ".join(re.findall(r"[\w@.+-]+", value.casefold()))
    return hmac.new(key, f"{kind}|{plain}".encode(), hashlib.sha256).hexdigest()[:10]


def _birth(value: str, key: bytes) -> str:
    """A date of birth as another one, written alike: year first, or day first (month first where the second number is no month)."""
    parts = [int(x) for x in re.findall(r"\d+", value)]
    order = (0, 1, 2) if parts[0] > 31 else (2, 1, 0) if parts[1] <= 12 else (2, 0, 1)
    y, m, d = (parts[i] for i in order)
    new = dict(zip(order, N.permute_date(y, m, d, key)))
    it = iter([f"{new[i]:0{len(x)}d}" for i, x in enumerate(re.findall(r"\d+", value))])
    return re.sub(r"\d+", lambda _: next(it), value)


# ---------------------------------------------------------------- patterns

_L = r"[^\s\d\x00-\x26\x28-\x40\[-`{-\x7f।¡¿«»“”…]"  # a letter or mark, or an apostrophe
_W = _L + "+"
_PART = rf"{_L}{{2,}}(?:-{_L}{{2,}})?"
_CAP = rf"(?-i:[^\W\d_a-zß-öø-ÿа-я])(?:{_L})+"

_EMAIL = re.compile(
    r"""(?ix)(?<![\w.+-])(?:mailto:)?[a-z0-9][a-z0-9._%+-]*
    (?:[ ]?@[ ]?|[ ]?[\[(][ ]?(?:at|@)[ ]?[\])][ ]?)
    (?:[a-z0-9-]+(?:\.|[ ]?[\[(][ ]?(?:dot|\.)[ ]?[\])][ ]?))+[a-z]{2,}(?![\w@])"""
)
#: Not personal, and not to be taken for it: links, order, tracking and one-time numbers; then amounts, dates and times.
_LINK = re.compile(r"(?i)(?:https?://|www\.)[^\s\x00]+")
_BUSINESS = re.compile(
    r"""(?ix)(?:\b(?:ord|inv|ref|tkt|awb|po|order|pedido|commande|bestellung|invoice|ticket|заказ|ऑर्डर)[\s:#./-]*(?:no\.?|number|nr\.?)?[\s:#-]*
    | \b(?:tracking|track|awb|consignment|shipment|envío|suivi|sendung\w*|rastreio|трек\w*)\b[^\d\x00\n]{0,16}
    | \b(?:code|otp|pin|código|kode|код|कोड)\b[^\d\x00\n]{0,10} | \# | @\w*)$"""
)
_WEAK = re.compile(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\d{1,2}/\d{1,2}")
_MONEY_BEFORE = re.compile(r"(?i)(?:[₹€$£]|\b(?:rs|inr|usd|eur|gbp)\.?)\s?$")
_MONEY_AFTER = re.compile(r"(?i)[ ]?(?:[₹€$£%]|(?:usd|eur|inr|gbp|rs|rupees|percent|рубл|руб|euros?|reais|dollars?)\b)")
_RUN = re.compile(r"[+(]?\d[\d ().\-/]{4,}\d")
_ID_CUE = re.compile(
    r"(?i)(?:\bids?\b|\bidenti|\bnational\b|passport|passeport|pasaporte|passaporte|паспорт|reisepass|ausweis|steuer|\bsocial\b|\bssn\b|aadhaar|aadhar|\bpan\b|\btax\b|\bdni\b|\bnie\b|\bcpf\b|\bcurp\b|\bnif\b|documento|insee|снилс|\bинн\b|पहचान|आधार|पैन|पासपोर्ट)[^\d\x00\n]{0,24}$"
)
#: Formats of identity numbers: two letters, six digits and a letter, five letters, four digits and a letter,
#: one or two letters and seven digits, three-two-four digits, three groups of four digits, eight digits and a letter.
_ID = re.compile(
    r"""(?ix)(?<![\w/#-])(?<!\d[ ])(?:[a-z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[a-d] | [a-z]{5}\d{4}[a-z] | [a-z]{1,2}\d{7}
    | \d{3}[ -]\d{2}[ -]\d{4} | \d{4}[ -]\d{4}[ -]\d{4} | \d{3}\.\d{3}\.\d{3}-\d{2} | \d{8}-?[a-z])(?![\w-]|[ ]?\d)"""
)
#: A payment card's number: groups of four, or fifteen digits in groups of four, six and five.
_CARD = re.compile(r"(?:\d{4}[ -]){3}\d{1,7}(?![\d-])|\d{4}[ -]\d{6}[ -]\d{5}(?![\d-])|\d{15,16}(?!\d)")
_FOUR = re.compile(r"[A-Za-z]\d{4}[A-Za-z]\b")
_PHONE = re.compile(r"(?:(?:\+|00)\d{1,3}|\(\d{2,5}\)|\d)(?:[ .\-]{0,2}\(?\d+\)?)+")
_GROUPED = re.compile(r"1?[ .-]?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}")
_PHONE_CUE = re.compile(r"(?i)call|phone|\btel\b|mobile|whatsapp|number|reach|\bring\b|\btext\b|\bsms\b|llám|llam|appel|\bruf|telefon|ligue|звон|номер|फ़ोन|फोन|नंबर")
#: What says that a number after it is to be called, though an identity number was spoken of before.
_CALL_CUE = re.compile(r"(?i)call|phone|whatsapp|\breach|llám|appelle|\bruf|ligue|звон|फ़ोन|(?:his|her|my|their) number\b|number:")

_UNIT = r"\b(?:house|flat|apt|apartment|plot|door|unit|suite)\b[ ]?(?:no\b\.?|number|\#)?[ ]?\d+[a-z]?(?:/\d+)?"
#: What stands before an English street word: a number, or a unit and its number, then up to three words.
_STREET_HEAD = re.compile(rf"(?i)(?:{_UNIT},?[ ]+)?(?<![\w/.:₹€$£-])(?<![₹€$£] )\d+[a-z]?(?:/\d+)?,?[ ]((?:{_W}[ ]){{1,3}})$|{_UNIT},[ ]*((?:{_W}[ ]){{1,3}})$")
_STREET_TAIL = re.compile(rf"(?:[ ]road|[ ]Road)?(?:,[ \n]*(?:near[ ])?{_L}{{3,}}(?:[ ](?:stadium|station|park|market|temple|church|mosque|school|hospital|mall|bridge|tower|square|gate)\b)?)?(?:[ ]\d{{5,6}}\b)?")
_AFTER_PLACE = re.compile(r"(?-i:[ ]?[.!?\n\x00]|[ ][A-Z]|[ ](?:by|this|near|ring)\b|$)")
_FRENCH_HEAD = re.compile(r"(?i)(?<![\w/.:₹€$£-])\d+(?:[ ](?:bis|ter|quater))?[ ]?,?[ ]$")
_FRENCH_TAIL = re.compile(rf"(?i)[ ](?:(?:de|du|des|la|le|les)[ ])*{_W}(?:,[ ]*(?:\d{{5}}[ ])?{_CAP})?")
_LATIN_TAIL = re.compile(rf"(?i)[ ](?:(?:de|del|da|do|dos|das|la|el)[ ])*((?:{_W}[ ]){{0,2}}{_W}),?[ ]?(?:n\.?[ºo°]?[ ]?|núm\.?[ ]?|nº[ ]?)?\d+[a-z]?\b(?:,[ ]*(?:piso|andar|puerta|apto\.?)[ ]?\d+)?(?:,[ ]*\d{{4,6}})?(?:,?[ ]{_CAP})?")
_GERMAN_TAIL = re.compile(rf"(?i)\.?[ ]\d+[ ]?[a-z]?\b(?:,?[ ](?:in[ ])?(?:\d{{5}}[ ])?{_CAP})?")
_RUSSIAN_TAIL = re.compile(rf"(?i)\.?[ ]?{_W}(?:[ ]{_W})?,?[ ](?:д\.|дом)?[ ]?\d+{_L}?(?:[ ]?,?[ ]?(?:кв\.?|квартира)[ ]?\d+)?")
_HINDI_UNIT = re.compile(rf"[ ](?:नंबर[ ]|सं\.?[ ]|संख्या[ ])?\d+[ ]?,[ ]*(?:{_W}[ ]?\d*[ ]?,?[ ]*){{0,3}}?(?:मार्ग|गली|नगर|रोड|सड़क|चौक|विहार|कॉलोनी|पथ)(?:[ ]\d+)?(?:,[ ]*{_W}[ ](?:नगर|विहार|कॉलोनी))?(?:,[ ]*\d{{6}})?")
_HINDI_HEAD = re.compile(rf"(?<![\w/.-])\d+(?:/\d+)?[ ]?,[ ](?:{_W}[ ]){{1,2}}$")

_TITLE = r"(?:dr|mr|mrs|ms|miss|prof|herr|frau|sr|sra|srta|mme|mlle|don|doña|श्री|श्रीमती|डॉ|г-н|г-жа)\.?"
_INITIAL = rf"{_L}\."
#: A person as written: title and family name; family name, given name; given name, initial, family name.
_PERSON = rf"(?:{_TITLE}[ ](?:{_L}{{2,}}[ ])??{_PART}|{_PART},[ ]{_L}{{2,}}|{_L}{{2,}}(?:[ ]{_INITIAL})?[ ]{_PART}|{_L}{{2,}}[ ]{_INITIAL}|{_PART})"
_PERSON_AT = re.compile(rf"(?i)[ \n]*({_PERSON})(?!{_L})")
_PERSON_END = re.compile(rf"(?i)(?:^|(?<=[\s\x00.,!?।]))({_PERSON}) $")
_BIG = r"(?-i:[A-ZÀ-ÖØ-ÞА-ЯЁ])"
_SMALL = r"(?-i:[a-zß-öø-ÿа-яё'’\u0100-\u024f])"
_GIVEN = rf"(?:{_BIG}['’])?{_BIG}(?:{_SMALL})+(?:-?{_BIG}(?:{_SMALL})+)?"
#: A person in general, told by capitals: two to four names, initials among them, with the particles of family names.
_FULL = rf"{_GIVEN}(?:[ ](?:(?:de|da|do|dos|del|la|van|von|der|den|bin|al|el|di|du|le)[ ]){{0,2}}(?:{_GIVEN}|{_BIG}\.)){{1,3}}"
_FULL_AT = re.compile(rf"[ ](?:(?:please|also|again|bitte|mal|doch|auch|aussi|también|também|тоже)[ ])?({_FULL})(?!{_L})")
_FULL_END = re.compile(rf"(?<!{_L})({_FULL}) $")
_FIELD_AT = re.compile(rf"(?:[ ](?:person|name))?[ ]?:[ ]?({_FULL})(?!{_L})")
_HONOURED_END = re.compile(r"(?:^|(?<=[\s\x00,।.]))((?:[\u0900-\u0963\u0970-\u097f]{2,}[ ])?[\u0900-\u0963\u0970-\u097f]{2,}) $")
_DATE_AT = re.compile(r"[^\d\x00\n.]{0,16}?(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}([./-])\d{1,2}\2\d{4})(?!\d)")
_TITLED = re.compile(rf"(?i){_TITLE}[ ]")
_TITLE_AT = re.compile(rf"\.?[ ](?:{_CAP}[ ])?{_CAP}(?:-{_CAP})?|\.?[ ][\u0900-\u097f]{{3,}}")
#: Words of no street or person name: articles, pronouns, prepositions, roles and the like.
_COMMON = frozenset(
    """the a an our my your his her their this that these those of on in at by for from to with without and or but so because since as if when while then than off over under after before until
    is are was were be been has have had will can could should must may need needs owes still free late please percent am pm boxes minutes people chairs vehicles not no new old other each every
    first last next more most less least many few some any all both team committee class clinic plumber electrician watchman driver coach shopkeeper finance delivery neighbour cousin
    somebody someone anyone everyone nobody who they we you he she it one board desk union office police fire town library market
    le la les l un une notre mon ma mes votre son sa leur il elle ils on nous vous qui el los las una nuestro nuestra mi su él ella ellos alguien quien por para y e o está es
    der die das ein eine unser unsere mein meine dein er sie wir ihr jemand wer os as um uma nosso nossa meu minha seu sua ele ela alguém quem und ist
    наш наша мой моя ваш он она они кто сосед соседка сантехник курьер вы мы и на в वह वे हम आप कौन कोई हमारे मेरे ऊपर नलसाज़ चालक sehr dear cher estimado""".split()
)

# Words in names of places, offices, firms and days, which are written like persons'.
_NO_PERSON = frozenset(
    """street road avenue lane drive park square bridge market station airport hospital clinic school college university bank office store stores shop mall centre center club society association committee council
    company ltd limited inc gmbh corp services service solutions group team department ministry court church temple mosque hotel restaurant cafe apartments tower towers gardens colony nagar road city town village
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december
    calle avenida plaza parque banco hospital escuela colegio tienda rue avenue place parc banque hôpital école marché magasin straße platz park bank krankenhaus schule markt rua praça banco escola mercado loja stadt apotheke verein amt rathaus bahnhof kirche laden firma
    улица площадь парк банк больница школа рынок магазин north south east west new old saint san santa""".split()
)

# Words that announce a finding, by what has to be looked for beside them.
_CUES = {
    "email": "@|[at]|(at)|[ at ]|( at )",
    "street": "street st road rd avenue ave lane boulevard blvd marg nagar",
    "place": "close drive court terrace place square crescent gardens way row walk highway",
    "french": "rue avenue boulevard place chemin impasse allée quai route",
    "latin": "calle avenida av plaza paseo carrera camino rua travessa praça alameda estrada",
    "german": "straße strasse str weg gasse allee platz ufer damm",
    "russian": "ул улица проспект переулок шоссе бульвар набережная",
    "hindi_unit": "मकान फ़्लैट फ्लैट घर प्लॉट भवन",
    "hindi": "मार्ग गली रोड सड़क पथ",
    "lead": "under the name|in the name of|my name is|auf den namen|ich heiße|a nombre de|me llamo|au nom de|je m'appelle|em nome de|meu nome é|на имя|меня зовут|मेरा नाम|के नाम से|hand it to|give it to|ask for|speak to",
    "sign": "regards,|sincerely,|cheers,|saludos,|atentamente,|cordialement,|grüße,|gruß,|atenciosamente,|abraços,|с уважением,|सादर,",
    "come": "will come with|will come to|will come tomorrow|is coming with|viendra demain|viendra avec|vendrá mañana|vendrá con|kommt morgen|kommt mit|virá amanhã|vem amanhã|придёт завтра|придёт с|приедет завтра|कल चाबी लेकर",
    # persons in general: what stands before them, what behind them, and what names a field
    "before": """tell|told|ask|asked|call|called|phone|phoned|ring|text|texted|email|emailed|contact|meet|met|saw|thank|thanks|invite|invited|remind|helped|know|knew|married|this is|i am|i'm|named|dear|hello|spoke to|spoke with|talked to|talk to|mother|father|brother|sister|son|daughter|uncle|aunt|cousin|friend|colleague|neighbour|neighbor|boss|teacher|doctor|lawyer|nurse|wife|husband|patient|tenant|passenger|guest
|dile a|avisa a|llama a|llamar a|pregunta a|pregúntale a|conocí a|vi a|habla con|hablé con|gracias a|soy|se llama|señor|señora|amigo|amiga|hermano|hermana|hijo|hija|madre|padre|tío|tía|doctora|profesor|profesora|vecino|vecina
|dis à|dites à|appelle|appelez|appeler|demande à|demandez à|rencontré|parlé à|parlé avec|parler à|merci à|je suis|s'appelle|monsieur|madame|ami|amie|frère|sœur|fils|fille|mère|père|oncle|tante|docteur|professeur|voisin|voisine
|ruf|rufe|rufen sie|frag|frage|fragen sie|sag|sagen sie|triff|treffe|traf|kenne|besuche|danke|ich bin|heißt|namens|freund|freundin|bruder|schwester|sohn|tochter|mutter|vater|onkel|doktor|lehrer|lehrerin|nachbar|nachbarin|kollege|kollegin
|diga a|diga ao|diga à|avise|avise a|chame|ligue para|pergunte a|conheci|encontrei|falei com|falar com|sou|chama-se|se chama|senhor|senhora|irmão|irmã|filho|filha|mãe|pai|tio|tia|doutor|doutora|vizinho|vizinha
|позвони|позвоните|скажи|скажите|спроси|спросите|встретил|встретила|видел|видела|знаю|зовут|господин|госпожа|друг|подруга|брат|сестра|сын|дочь|мама|папа|дядя|тётя|доктор|врач|учитель|учительница|сосед|соседка|коллега""".replace("\n", ""),
    "after": """called|phoned|texted|emailed|wrote|said|says|told|asked|asks|wants|wanted|lives|lived|works|worked|came|comes|visited|arrived|arrives|left|moved|thinks|knows|promised|agreed|forgot|helped|met|sent|brought|is my|is our|is coming|is not coming|isn't coming|is here|will come|will call|will be late|will bring|will pick|won't come|cannot come|can't come|has arrived|has left|has moved
|llamó|dijo|dice|vive|trabaja|viene|vino|vendrá|no vendrá|no viene|llegó|llega|llegará|quiere|escribió|preguntó|es mi|es nuestro|es nuestra|ha llamado|ha llegado
|a appelé|a dit|a téléphoné|a écrit|habite|travaille|vient|viendra|ne viendra|ne vient|arrive|arrivera|est arrivé|est arrivée|veut|est mon|est ma|est notre
|hat angerufen|hat gesagt|hat geschrieben|rief|sagte|sagt|wohnt|arbeitet|kommt|kam|möchte|schrieb|fragt|fragte|ist mein|ist meine|ist unser|ist hier
|ligou|disse|diz|mora|trabalha|vem|veio|virá|não virá|não vem|chegou|quer|escreveu|perguntou|é meu|é minha|é nosso
|позвонил|позвонила|сказал|сказала|написал|написала|живёт|живет|работает|придёт|придет|пришёл|пришла|приехал|приехала|приедет|не придёт|хочет|просит|просил|просила""".replace("\n", ""),
    "label": "contact|person|name|patient|tenant|customer|passenger|guest|recipient|sender|signed|attn|ansprechpartner|empfänger|absender|nombre|nom|nome|имя|фио|получатель|नाम|संपर्क",
    "honoured": "जी",
    "born": "born|birthday|date of birth|dob|né le|née le|date de naissance|nacido|nacida|fecha de nacimiento|geboren|geburtsdatum|nascido|nascida|data de nascimento|родился|родилась|дата рождения|जन्म",
    "title": "dr mr mrs ms prof herr frau mme mlle श्री श्रीमती डॉ",
}


@lru_cache(1)
def _cues():
    """All announcing words as one automaton, so that a batch is read once for them."""
    import ahocorasick

    words: dict[str, list[str]] = {}
    for kind, text in _CUES.items():
        for w in text.split("|") if "|" in text else text.split():
            words.setdefault(w, []).append(kind)
    a = ahocorasick.Automaton()
    for w, kinds in words.items():
        a.add_word(w, (len(w), kinds))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def _word(text: str, a: int, b: int) -> bool:
    """No letter touches this stretch."""
    return not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum() or "\u0900" <= text[b : b + 1] <= "\u0963")


def _plain(words: str) -> bool:
    return any(w.casefold().strip("'’,") in _COMMON for w in words.split())


def _spans(joined: str, birth_dates: bool = False) -> list[tuple[int, int, str]]:
    """Begin, end and kind of every finding, in order and without overlaps."""
    taken = bytearray(len(joined) + 1)
    out: list[tuple[int, int, str]] = []

    def take(a: int, b: int, kind: str) -> bool:
        if a >= b or taken.find(1, a, b) >= 0:
            return False
        taken[a:b] = b"\x01" * (b - a)
        if kind:
            out.append((a, b, kind))
        return True

    low = _lower(joined)
    hits: dict[str, list[tuple[int, int]]] = {k: [] for k in _CUES}
    for end, (size, kinds) in _cues().iter(low):
        for k in kinds:
            hits[k].append((end + 1 - size, end + 1))
    for a, b in hits["email"]:
        lo = max(0, a - LOCAL - 16, joined.rfind(GAP, 0, a) + 1)
        for m in _EMAIL.finditer(joined, lo, min(len(joined), b + DOMAIN)):
            if m.start() <= a < m.end():
                take(*m.span(), "email")
    for m in _LINK.finditer(joined):
        take(*m.span(), "")
    for kind, tail in (("hindi_unit", _HINDI_UNIT), ("latin", _LATIN_TAIL), ("russian", _RUSSIAN_TAIL)):
        for a, b in hits[kind]:
            if _word(joined, a, b) and (m := tail.match(joined, b)) and not (kind == "latin" and _plain(m[1])):
                take(a, m.end(), "address")
    for a, b in hits["french"]:
        if _word(joined, a, b) and (h := _FRENCH_HEAD.search(joined, max(0, a - 16), a)) and (m := _FRENCH_TAIL.match(joined, b)):
            take(h.start(), m.end(), "address")
    for a, b in hits["german"]:
        if joined[a - 1 : a].isalpha() and (m := _GERMAN_TAIL.match(joined, b)):
            start = a
            while start and joined[start - 1].isalpha():
                start -= 1
            if a - start >= 3:
                take(start, m.end(), "address")
    for a, b in hits["hindi"]:
        if _word(joined, a, b) and (h := _HINDI_HEAD.search(joined, max(0, a - REACH), a)):
            take(h.start(), b, "address")
    for kind in ("street", "place"):
        for a, b in hits[kind]:
            if not _word(joined, a, b) or not (h := _STREET_HEAD.search(joined, max(0, a - REACH, joined.rfind(GAP, 0, a) + 1), a)):
                continue
            name = h[1] or h[2]
            alone = len(name.split()) == 1 and (joined[b : b + 1] == "," or "," in h[0] and _AFTER_PLACE.match(joined, b))
            named = joined[a].isupper() and name[0].isupper() or alone
            if _plain(name) or kind == "place" and not named and not re.match(_UNIT, h[0], re.I):
                continue
            take(h.start(), _STREET_TAIL.match(joined, b).end(), "address")
    for m in _FOUR.finditer(joined):
        if (x := _ID.search(joined, max(0, m.start() - 5), m.end() + 1)) and x.end() == m.end():
            take(*x.span(), "id_number")
    for m in _RUN.finditer(joined):
        a, b = m.span()
        if _WEAK.fullmatch(m[0].strip("( .)")):
            continue
        before = joined[max(0, a - 40, joined.rfind(GAP, 0, a) + 1) : a]
        if _BUSINESS.search(before) or _MONEY_BEFORE.search(before) or _MONEY_AFTER.match(joined, b):
            continue
        if x := _ID.search(joined, max(0, a - 3), min(len(joined), b + 3)):
            take(*x.span(), "id_number")
            continue
        if (c := _CARD.match(joined, a)) and (known := N.format_of(c[0])) and known[0].name == "card":
            take(*c.span(), "id_number")
            continue
        p = _PHONE.match(joined, a) or _PHONE.match(joined, a + 1)
        if not p:
            continue
        a, b = p.span()
        while b > a and not (joined[b - 1].isdigit() or joined[b - 1] == ")"):
            b -= 1
        digits = sum(c.isdigit() for c in joined[a:b])
        if not 7 <= digits <= 15 or joined[a - 1 : a].isalnum() or joined[b : b + 1].isalnum() or joined[a - 1 : a] in ("/", "#", "@") or joined[a - 1 : a] == ":" and joined[a - 2 : a - 1].isdigit():
            continue
        cue = _ID_CUE.search(before)
        if cue and joined[a] not in "+(" and not _CALL_CUE.search(before, cue.start()):
            take(a, b, "id_number")
        elif (digits >= 8 and (joined[a] in "+(0" or _PHONE_CUE.search(before))) or _GROUPED.fullmatch(joined, a, b):
            take(a, b, "phone")
    for kind in ("lead", "sign"):
        for a, b in hits[kind]:
            if joined[a - 1 : a].isalnum() or not (m := _PERSON_AT.match(joined, b)):
                continue
            first = re.match(_W, m[1])[0].casefold()
            if first not in _COMMON:
                take(*m.span(1), "name")
    for a, b in hits["come"]:
        lo = max(0, a - REACH, joined.rfind(GAP, 0, a) + 1)
        if not (m := _PERSON_END.search(joined, lo, a)):
            continue
        start, words = m.start(1), m[1].split()
        if not _TITLED.match(m[1]) and any(w[0].isupper() for w in words):
            while words and words[0][0].islower():
                start += len(words.pop(0)) + 1
        if words and words[0].casefold().strip(",") not in _COMMON and not (lo < start and joined[lo:start].rstrip().casefold().rpartition(" ")[2] in ("the", "our", "my", "der", "die", "le", "la", "el", "o", "a")):
            take(start, a - 1, "name")
    for a, b in hits["title"]:
        if _word(joined, a, b) and (joined[a].isupper() or joined[a] > "\u0900") and (m := _TITLE_AT.match(joined, b)) and not _plain(m[0].lstrip(".")):
            take(a, m.end(), "name")
    for a, b in hits["before"]:
        if _word(joined, a, b) and (m := _FULL_AT.match(joined, b)):
            _person(take, m[1], m.start(1))
    for a, b in hits["label"]:
        if _word(joined, a, b) and (m := _FIELD_AT.match(joined, b)):
            _person(take, m[1], m.start(1))
    for a, b in hits["after"]:
        if joined[a - 1 : a] == " " and _word(joined, a, b) and (m := _FULL_END.search(joined, max(0, a - REACH, joined.rfind(GAP, 0, a) + 1), a)):
            _person(take, m[1], m.start(1))
    for a, b in hits["honoured"]:
        if joined[a - 1 : a] == " " and _word(joined, a, b) and (m := _HONOURED_END.search(joined, max(0, a - REACH, joined.rfind(GAP, 0, a) + 1), a)) and not _plain(m[1]):
            take(m.start(1), a - 1, "name")
    for a, b in hits["born"] if birth_dates else ():
        if _word(joined, a, b) and (m := _DATE_AT.match(joined, b)) and _is_date(m[1]):
            take(*m.span(1), BIRTH)
    return sorted(out)


def _person(take, name: str, at: int) -> None:
    """Take a name told by capitals, without common words at its head, unless it is that of a place, office or firm."""
    words = name.split()
    while words and words[0].casefold().strip("'’") in _COMMON:
        at += len(words.pop(0)) + 1
    while words and words[-1].casefold() in _COMMON:  # the next sentence begins without a mark
        words.pop()
    if len(words) >= 2 and not any(w.casefold().strip("'’.") in _NO_PERSON for w in words):
        take(at, at + len(" ".join(words)), "name")


def _is_date(text: str) -> bool:
    try:
        _birth(text, b"")
        return True
    except ValueError:
        return False


def find(texts: list[str], size: int = 400_000, birth_dates: bool = False) -> list[list[tuple[int, int, str]]]:
    """Findings of each text, as begin, end and kind in characters of the text."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) < size):
            total += len(texts[hi]) + 1
            hi += 1
        part = [t.replace(GAP, " ") for t in texts[lo:hi]]
        off = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
        for a, b, kind in _spans(GAP.join(part), birth_dates):
            r = int(np.searchsorted(off, a, "right")) - 1
            out[lo + r].append((int(a - off[r]), int(b - off[r]), kind))
        lo = hi
    return out


def replace(text: str, findings: list[tuple[int, int, str]], key: bytes) -> str:
    """The text with each finding as ``<KIND:pseudonym>``; the rest unchanged."""
    parts, at = [], 0
    for a, b, kind in findings:
        parts += [text[at:a], f"<{kind.upper()}:{pseudonym(kind, text[a:b], key)}>"]
        at = b
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, text_col: str, keep: list[str], key: bytes, birth_dates: bool = False) -> DataFrame:
    """``keep`` columns with ``redacted`` text and the ``kinds`` found in ``text_col``.

    Found is what the text shows: it is read in its one form (see ``normalize``), so full-width
    digits or invisible characters hide nothing, and comes out in that form. Null stays null
    with no kinds, an empty text stays empty, texts of any length are read whole, each row on its
    own, so repeated rows get equal results. Equal values get equal pseudonyms wherever the same
    secret ``key`` is used. With ``birth_dates`` dates of birth are permuted, too; they are no kind. ``keep`` must not name ``redacted`` or ``kinds``.
    """
    if {"redacted", "kinds"} & set(keep):
        raise ValueError("keep must not have columns redacted or kinds")
    fields = df.select(*keep).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "redacted string", "kinds array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = C.canonical_arrow(b.column("__text"))[0].to_pylist()
            found = find([t or "" for t in text], birth_dates=birth_dates)
            red = [t if t is None or not f else replace(t, f, key) for t, f in zip(text, found)]
            kinds = [sorted({k for _, _, k in f if k in KINDS}) for f in found]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(red, pa.string()), pa.array(kinds, pa.list_(pa.string()))], [*keep, "redacted", "kinds"])

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)
