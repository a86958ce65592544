"""The rule catalogue: each rule is a row of data, evaluated by one generic extractor.

A rule has a cue (``pre``, consumed), what it captures (``core``, without capturing groups) and
``anchors``: lower-case strings one of which a text must hold for the rule to hit at all, so most
rules cost a text without their words one search for a string. Cue words fold case in a scope of
their own; names never do, since their capitals are what tells them from prose.
"""

from __future__ import annotations

from typing import NamedTuple

# --- parts --------------------------------------------------------------------------------------
SP = r"[^\S\r\n]"  # a blank that ends no line
GAP = SP + "+"
OPEN = r"(?<!\p{L})"
SHUT = r"(?!\p{L})"


def either(*parts: str) -> str:
    return "(?:" + "|".join(parts) + ")"


def fold(*parts: str) -> str:
    """The parts in any case."""
    return "(?iu:" + "|".join(parts) + ")"


def spelled(words: str) -> str:
    """Words that a list names, as alternatives in any case; ``_`` is white space."""
    return fold(*(w.replace("_", r"\s+") for w in words.split()))


def maybe(part: str) -> str:
    return f"(?:{part})?"


# a name: capitals first, apostrophes inside and, for an accent in capitals, at the end
NAME = r"\p{Lu}(?:['’]?\p{L})++'?"
FULL = rf"{NAME}(?:{GAP}{NAME}){{1,3}}"
WRAPPED = rf"{NAME}(?:{either(GAP, SP + r'*\n' + SP + '*')}{NAME}){{1,3}}"
DOTTED = r"\p{Lu}\.(?:[^\S\n]?\p{Lu}\.){1,2}"  # initials

DOCTOR = fold(r"d(?:ott|r)(?:\.\s?ssa|ssa|\.)?") + SHUT
LAWYER = fold(r"avv(?:\.|ocat[oi]|ocatessa)")
TITLE = either(DOCTOR, LAWYER, fold(r"prof\.(?:\s?ssa)?", r"ref\.", r"cons\."))
COURTESY = fold(r"sig(?:\.(?:\s?r[ae]|\s?na)?|nor[ae]?)") + SHUT
PROFESSION = fold(r"ing\.", r"geom\.", r"arch\.", r"rag\.")
TITLED = either(COURTESY, PROFESSION, fold(r"d(?:ott|r)\.(?:\s?ssa)?", r"prof\.(?:\s?ssa)?", "notaio", r"not\.") + SHUT)

# --- who judges ---------------------------------------------------------------------------------
BENCH_ROLE = spelled(r"presidente consiglier[ea] giudice (?:primo_)?referendari[oa] sostituto_procuratore procuratore_generale \bp\.?\s?g\.?(?!\p{L}) cancelliere segretari[oa] relat(?:ore|rice) estensore componente")
JUDICIAL = rf"{BENCH_ROLE}(?:\s+{fold('e' + chr(92) + 's+')}?{spelled('relatore estensore monocratico istruttore generale delegato unico')})?{SHUT}"
BENCH_ANCHORS = ("presiden", "consiglier", "giudic", "referendari", "procurator", "p.g", "p. g", "pg", "cancellier", "segretari", "relat", "estensor", "component")


class Judge(NamedTuple):
    pre: str
    core: str
    anchors: tuple[str, ...] = BENCH_ANCHORS


_THEN_FIELD = rf"(?={SP}*(?:\n|\z|{spelled('presidente relatore estensore giudice data')}))"
#: Judges by a role in front of the name or behind it (in a look-ahead).
JUDGES = [
    # a field of the heading, to the end of the line or the next field
    Judge(rf"(?<!\p{{L}}){spelled('presidente relatore estensore giudice')}{SP}*:{SP}*{maybe(TITLE + SP + '*')}", rf"{NAME}(?:{GAP}(?!{spelled('presidente relatore estensore giudice data')}\b){NAME}){{1,3}}{_THEN_FIELD}"),
    # abbreviated roles
    Judge(rf"(?<![\p{{L}}.])(?:G\.{SP}?I\.|{fold('pres', 'est', 'rel')}\.(?:{GAP}{fold('ed?')}{GAP}{fold('est', 'rel')}\.)?){GAP}{maybe(TITLE + SP + '*')}", FULL, ("g.i.", "g. i.", "pres.", "est.", "rel.")),
    # from or of the judge
    Judge(rf"{OPEN}{fold('dal', 'dalla', 'del', 'della', 'da')}\s+{JUDICIAL}\s+{maybe(TITLE + SP + '*')}", FULL),
    # a second role over a line break
    Judge(rf"{OPEN}{fold('consiglier[ea]')}\s+{fold('relat(?:ore|rice)', 'estensore')}\s+{maybe(TITLE + SP + '*')}", FULL, ("consiglier",)),
    Judge(rf"{OPEN}{fold('sostitut[oa]')}\s+{fold('procurator[ei]')}(?:\s+{fold('generale')})?\s+{maybe(TITLE + SP + '*')}", FULL, ("procurator",)),
    # the name first: a line of a heading, a dash, a wide column
    Judge(rf"(?m)^{SP}*", rf"{FULL}(?=(?:{GAP}\p{{Lu}}\.?)?{SP}*,{SP}*{JUDICIAL})"),
    Judge("", rf"{FULL}(?=\s*[-–]{SP}*{JUDICIAL}\s*[-–])"),
    Judge(rf"{OPEN}{fold('il', 'la')}\s+{JUDICIAL}\s+{DOCTOR}\s*", FULL),
    Judge(rf"{OPEN}{fold('avvocat[oa]')}\s+{fold('general[ei]')}\s*[:\n]\s*", FULL, ("avvocat",)),
    # a role alone on its line and the name alone below
    Judge(rf"(?m)^{SP}*(?:{fold('il', 'la')}\s+|{fold('l')}['’]\s*)?{JUDICIAL}{SP}*(?:\n{SP}*){{1,4}}{maybe(TITLE + SP + '*')}", rf"{FULL}(?={SP}*(?:\n|\z))"),
    Judge(rf"{OPEN}(?:{fold('cons')}\.|{fold('consiglier[ea]', 'referendari[oa]')})\s+{maybe(TITLE + SP + '*')}", FULL, ("cons.", "consiglier", "referendari")),
    Judge(rf"{fold('nella')}\s+{fold('persona')}\s+{fold('della?')}\s+{JUDICIAL}[\s,]+{maybe(TITLE + chr(92) + 's*')}", WRAPPED, ("persona",)),
    Judge(rf"{OPEN}{DOCTOR}\s*", rf"{FULL}(?=(?:{SP}{{2,}}|\s*\n\s*|\s*,\s*){JUDICIAL})"),
]


class Reach(NamedTuple):
    """A cue, and the text behind it up to ``most`` characters and the first ``stop``."""

    cue: str
    most: int
    stop: str
    anchors: tuple[str, ...]


#: Benches: every plausible name within reach is a judge.
BENCHES = [
    Reach(rf"{fold('compost[oa]')}\s+{fold('da(?:i|gl?i|ll[ae])?')}\s+(?:{fold('seguenti')}\s+)?(?:{fold('sigg?[.]?ri', 'signori')}\s+)?{fold('magistrat[oi]')}\s*:?", 400, rf"{spelled('ha_pronunciato')}|{OPEN}{spelled('sentenza ordinanza decreto')}{SHUT}|{spelled('nel_giudizio promoss[oa]_da propost[oa]_da nei_confronti_di')}", ("compost",)),
    Reach(rf"{spelled('ha_pronunciato_la_presente')}\s+{spelled('sentenza ordinanza decreto')}(?=[^\n]*{JUDICIAL})", 400, r"\n", ("ha pronunciato",)),
]
#: A role, a clause, and a title that makes the distance safe: the first such name is the judge.
CLAUSED = Reach(rf"(?:{JUDICIAL}|{OPEN}{fold('magistrat[oi]')})", 160, r"\n\n", (*BENCH_ANCHORS, "magistrat"))
CLAUSED_MOST = 90

# --- what is kept -------------------------------------------------------------------------------
_SLASHED = r"[0-9]{1,6}\s?/\s?[0-9]{2,4}(?![0-9])"
#: States before the European court of human rights, as decisions write them (fixed values).
STATES = """Albania Andorra Armenia Austria Azerbaigian Belgio Bosnia[-\\s]Erzegovina Bulgaria Cipro Croazia Danimarca Estonia Finlandia
Francia Georgia Germania Grecia Irlanda Islanda Italia Lettonia Liechtenstein Lituania Lussemburgo Macedonia(?:_del_Nord)? Malta Moldavia
Moldova Monaco Montenegro Norvegia Paesi_Bassi Polonia Portogallo Regno_Unito Repubblica_Ceca Romania Russia San_Marino Serbia Slovacchia
Slovenia Spagna Svezia Svizzera Turchia Ucraina Ungheria""".split()
_PARTY_WORD = either(NAME, r"(?:\p{Lu}\.)+")
_JOINT = either("de", "del", "della", "di", "da", "van", "von", "der", "den", "y", "e", "ed")
_CITED = rf"{_PARTY_WORD}(?:{GAP}(?:{_PARTY_WORD}|{_JOINT}(?={GAP}\p{{Lu}})))*"
_VERSUS = either(r"c\.", "contro")


class Case(NamedTuple):
    pre: str
    core: str
    anchors: tuple[str, ...]


_NUMBERED = rf"{OPEN}{fold('nn?[.]?', 'numero', 'n°')}\s*{_SLASHED}"
_OF_A_YEAR = r"(?<![\d/])[0-9]{1,6}\s?/\s?(?:19|20)[0-9]{2}(?![0-9])"
_REGISTER = rf"{OPEN}(?:{fold('r[.]?')}\s?{fold('g[.]?')}(?:\s?{fold('n[.]?')})?|{spelled('ruolo_generale')})[\s.:n°]*{_SLASHED}"
_EUROPEAN = rf"{OPEN}{fold('ecli')}:[A-Z]{{2}}:[A-Z]+:[0-9]{{4}}:\w+"
CASES = [
    Case("", either(_NUMBERED, _OF_A_YEAR, _REGISTER, _EUROPEAN), ("/", "ecli")),
    # the applicant against a State, and the parties behind a number of the court of justice
    Case(r"(?<![\p{L}'’.])", rf"{_CITED}(?=(?:{GAP}{fold('ed?')}{GAP}{fold('altri')})?{GAP}{_VERSUS}{GAP}{either(*(s.replace('_', chr(92) + 's+') for s in STATES))}(?!\p{{L}}|{GAP}\p{{Lu}}))", (" c. ", " contro ")),
    Case(rf"(?<![\p{{L}}\p{{N}}])[CT][-–]{SP}?[0-9]{{1,4}}/[0-9]{{2}}(?:{GAP}P)?,{GAP}", rf"{_CITED}(?:{GAP}{_VERSUS}{GAP}{_CITED})?", ("c-", "c–", "t-", "t–")),
]

# --- structured identifiers ---------------------------------------------------------------------
_NUMBER = fold(r"n(?:r|um(?:ero)?)?[.°]?") + rf"{SP}*[.:]?{SP}*"
_SLOT = "[0-9LMNPQRSTUV]"  # a digit of a tax code, or the letter that may stand for it


def _spaced(*runs: tuple[str, int]) -> str:
    """Characters with at most one blank between two."""
    every = [c for c, n in runs for _ in range(n)]
    return " ?".join(every)


TAX_CODE = _spaced(("[A-Z]", 6), (_SLOT, 2), ("[ABCDEHLMPRST]", 1), (_SLOT, 2), ("[A-Z]", 1), (_SLOT, 3), ("[A-Z]", 1))
MONTHS = "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre"
_UNITS = "un[oa]? due tre[’']? quattro cinque sei sette otto nove".split()
_TENS = "dieci undici dodici tredici quattordici quindici sedici diciassette diciotto diciannove".split()
_DAY_WORDS = ["prim[oa]", *_UNITS, *_TENS, "vent(?:i(?:due|tr[eèé]['’]?|quattro|cinque|sei|sette|nove)?|uno|otto)", "trent(?:a|uno)"]
_MONTH = spelled(MONTHS)
_YEAR_WORDS = fold(r"mille\p{L}+", r"duemila\p{L}*")
DATE = either(
    r"[0-9]{1,2}(?:[./-][0-9]{1,2}){1}[./-](?:[0-9]{4}|[0-9]{2})",
    rf"[0-9]{{1,2}}°?\s+{_MONTH}\s+(?:[0-9]{{4}}|{_YEAR_WORDS})",
    rf"{fold(*_DAY_WORDS)}\s+{_MONTH}\s+(?:[0-9]{{4}}|{_YEAR_WORDS})",
)
_BORN = rf"{OPEN}{fold('nat[oaie](?:/[oaie])?', 'nascit[ao]', 'nasceva', 'nacque', r'd[.]d[.]n[.]')}"
_TOWN_PART = rf"\p{{Lu}}[\p{{L}}'’.-]*(?:{GAP}[\p{{L}}'’-]+){{0,3}}?"
_IN_TOWN = rf"(?:{fold('ad?', 'in')}\s+{_TOWN_PART}(?:\s*,?\s*(?:\([^()\n]{{2,40}}\)|{fold('prov')}\.?\s*(?:{fold('di')}\s+)?\p{{Lu}}{{2}}(?!\p{{L}})))?\s*,?\s+)?"
_ON_DAY = rf"(?:{fold('il')}\s+{fold('giorno')}|{fold('in')}\s+{fold('data')}|{fold('il', 'nel', 'del')}{SHUT}|{fold('l')}['’])?\s*"
_LETTERED = r"(?=[0-9]*[A-Z])(?=[A-Z]*[0-9])[A-Z0-9]"
_ACTS = spelled(r"deliber\p{L}* provvediment\p{L}* decret\p{L}* sentenz\p{L}* ordinanz\p{L}* protocoll\p{L}* circolar\p{L}* verbal\p{L}*")


class Structured(NamedTuple):
    label: str
    pre: str
    core: str
    anchors: tuple[str, ...] = ()
    shape: str = ""  # what an unanchored rule's text must hold


STRUCTURED = [
    Structured("CF", "", rf"(?<![\p{{L}}\p{{N}}])(?i:{TAX_CODE})(?![\p{{L}}\p{{N}}])", shape=r"\d"),
    Structured("IVA", rf"{OPEN}(?:{fold('c[.]?')}\s?{fold('f[.]?')}\s?/\s?)?(?:{fold('p[.]?')}\s?{fold('iva')}|{fold('partita', 'codice')}\s+{fold('iva')})[\s:.n°]*(?:IT{SP}?)?", r"[0-9]{11}(?![0-9])", ("iva",)),
    Structured("Iban", "", r"(?<![\p{L}\p{N}])IT ?[0-9]{2}(?: ?[A-Z0-9]){23}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])(?!IT)[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])", shape=r"[A-Z]{2} ?[0-9]{2}"),
    Structured("Pec", "", rf"[\p{{L}}\p{{N}}_.%+-]+@{fold(r'legalmail[.]', r'postacert[.]', r'(?:[a-z0-9-]+[.])*[a-z0-9-]*(?:pec|cert)[a-z0-9-]*[.]', r'pec[.]')}[\p{{L}}\p{{N}}.-]*\p{{L}}{{2,}}", ("@",)),
    Structured("Email", "", r"[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}", ("@",)),
    Structured("Telefono", rf"{OPEN}{spelled('telefono tel cellulare cell fax mobile')}{SHUT}[\s:.n°/]*", r"(?:\+39[ \t.-]?)?[0-9](?:[ \t./-]?[0-9]){6,13}(?![0-9])", ("tel", "cell", "fax", "mobile")),
    Structured("Telefono", "", r"\+39[ \t.-]?[0-9](?:[ \t./-]?[0-9]){6,13}(?![0-9])", ("+39",)),
    Structured("Documento", rf"(?:{OPEN}(?:{fold('carta')}\s+{fold('di')}?(?:{fold('d')}['’])?\s*{fold('identit[àa]')}['’]?(?:\s+{fold('elettronica')})?|{spelled('passaporto passport')}|{fold('patente')}(?:\s+{fold('di')}\s+{fold('guida')})?|{fold('documento')}\s+{fold('di')}?(?:{fold('d')}['’])?\s*{spelled('identit[àa] riconoscimento')})|(?<![\p{{L}}.])(?:C\.I\.(?:E\.)?|CIE(?!\p{{L}})))(?:{GAP}{fold('rilasciat[oa]', 'italian[oa]')})?[\s:,(.]*(?:{_NUMBER})?", rf"(?:[A-Z]{{2}} ?[0-9]{{5,7}}[A-Z]{{0,2}}|{_LETTERED}{{8,10}})(?![\p{{L}}\p{{N}}])", ("carta", "passa", "passport", "patente", "documento", "c.i.", "cie")),
    Structured("Conto", rf"{OPEN}(?:{fold('conto')}\s+{fold('corrente')}|{fold('c/c')})(?:\s+{fold('bancario', 'postale')})?{SP}*:?{SP}*(?:{_NUMBER})?", r"[0-9]{6,15}(?![0-9/])", ("conto", "c/c")),
    Structured("Targa", "", r"(?<![\p{L}\p{N}])[A-Z]{2}\s?[0-9]{3}\s?[A-Z]{2}(?![\p{L}\p{N}])", shape=r"[A-Z]{2}\s?[0-9]{3}\s?[A-Z]{2}"),
    Structured("Data_nascita", rf"{_BORN}[\s,:]*{_IN_TOWN}{_ON_DAY}", rf"{DATE}(?![\p{{L}}0-9])", ("nat", "nasc", "nacque", "d.d.n")),
    Structured("Data_nascita", rf"{_BORN}\s+{fold('ad?', 'in')}\s+{_TOWN_PART}(?:{GAP}\(\p{{Lu}}{{2}}\))?\s*\(\s*{_ON_DAY}", rf"{DATE}(?=\s*\))", ("nat", "nasc")),
]

#: Professional registers: a number within reach of the register's name, no act between.
REGISTER = Reach(rf"{OPEN}(?:{spelled('albo ordine collegio')}{GAP}{spelled('degli dei delle del nazionale speciale unico professionale')}{SHUT}|{spelled('registro_(?:dei|degli)_revisori')}|REA{SHUT}|{fold('r[.]e[.]a[.]')})", 170, rf";|\n{SP}*\n|(?<=\p{{L}}{{5}})\.|{OPEN}{_ACTS}", ("albo", "ordine", "collegio", "registro", "rea", "r.e.a"))
REGISTER_NUMBER = (rf"{OPEN}(?:{fold('n[.]', 'n°', 'nr[.]?', 'numero', 'matricola')}){SP}*", r"[A-Z]{0,3}-?[0-9]{1,7}(?:/[A-Z0-9]{1,3})?(?![0-9/]|[.,][0-9])")
REGISTER_AT = 6  # the place of its label in the order of STRUCTURED, which settles ties

# --- organisations, streets ---------------------------------------------------------------------
_FORM_LETTERS = ["SPA", "SRLS", "SRL", "SAS", "SNC", "SCARL", "SCPA", "SAPA", "SSD"]
SUFFIX = fold(*(r"[^\S\n]?".join(c + r"\.?" for c in form) for form in _FORM_LETTERS), r"s\.?\s?c\.?\s?a\s+r\.?\s?l\.?", r"soc\.\s?coop\.(?:\s?a\s?r\.?l\.?)?", "onlus") + SHUT
#: Fixed values. Heads of public bodies. Stems end open: any word that begins so counts.
PUBLIC_STEMS = r"""agenzi[ae] minister[oi] ministro istitut[oi] avvocatura comune regione provincia citt[àa]_metropolitana universit
azienda_(?:ospedaliera|sanitaria|unit[àa]) equitalia riscossione presidenza consiglio procura pretura tribunale corte commissione_tributaria
prefettura questura camera_di_commercio poste_italiane ferrovie direzione_(?:provinciale|regionale|centrale|generale) ufficio ente(?!\p{L})
croce_rossa guardia_di_finanza polizia carabinieri repubblica stato(?!\p{L}) governo senato parlamento demanio dogan monopoli finanz erario tesoro
assessorat soprintendenz sovrintendenz motorizzazione ispettorat fallimento curatela condominio parrocchia diocesi catast[oa] autorit[àa]
parco_(?:regionale|nazionale|naturale) unione_(?:dei_)?comuni roma_capitale generale_dello area_vasta cancelleria segreteria cassazione"""
#: Their acronyms, whole words with or without dots.
PUBLIC_ACRONYMS = "INPS INAIL INPGI INPDAP ASL ADER ASUR ASP AUSL USL ULSS ASST ATS AOU IRCCS CUC"
#: Fixed values. Heads of organisations that are neither public bodies nor people.
PRIVATE_STEMS = r"""banc(?:a|he|o_(?:di|popolare)) cassa(?!\p{L}) credito cooperativa coop(?!\p{L}) consorzio societ[àa] associazione fondazione assicurazion[ei]
autostrade immobiliare costruzioni impresa ditta(?!\p{L}) studio(?!\p{L}) holding group(?!\p{L}) gruppo editrice editoriale industri[ae] trasporti servizi energia petrol
farmaceutic agricola agriturismo vivai cantine tenuta hotel albergo clinica casa_di_cura"""
PUBLIC = rf"{OPEN}(?:{spelled(PUBLIC_STEMS)}|{fold(*('[.]?'.join(a) + '[.]?' for a in PUBLIC_ACRONYMS.split()))}{SHUT})"
ORGANISATION = rf"{OPEN}(?:{spelled(PUBLIC_STEMS + ' ' + PRIVATE_STEMS)}|{fold(*('[.]?'.join(a) + '[.]?' for a in PUBLIC_ACRONYMS.split()))}{SHUT})"
_STREETS = r"""via viale v\.le vle piazza p\.zza p\.za piazzale piazzetta largo l\.go corso c\.so vicolo vico strada str\. stradone localit[àa] loc\. frazione fraz\.
contrada c\.da borgo lungotevere lungomare lungarno riviera parco salita calle campo traversa circonvallazione"""
STREET_WORD = spelled(_STREETS)
_OF = rf"(?:{fold('d(?:i|el|ell[aoe]|ei|egli)')}\s+|{fold('dell', 'd')}['’]\s*)?"
_CIVIC = rf"(?:{fold('n[.°]?', 'nr[.]?', 'num[.]?', 'civ[.]?', 'civico', 'numero')}{SP}*)?[0-9]{{1,4}}(?:/?[A-Za-z]|/[0-9]{{1,3}})?(?![\p{{L}}\d/])"
STREET = rf"{OPEN}{STREET_WORD}{GAP}{_OF}(?:\p{{Lu}}|[0-9]{{1,2}}°?{GAP}\p{{Lu}})[\p{{L}}\d'’.-]*(?:{GAP}[\p{{L}}\d'’-]+\.?){{0,6}}?{SP}*,?{SP}*{_CIVIC}(?:{SP}*,?{SP}*[0-9]{{5}}(?!\d))?"
_GERMAN = rf"(?:\p{{Lu}}[\p{{L}}-]*{GAP})?[\p{{L}}-]*{fold('stra(?:ß|ss)e', 'weg', 'platz', 'gasse', 'allee', 'ring')}{GAP}[0-9]{{1,4}}[a-z]?(?![\p{{L}}\d])"
_FRENCH = rf"[0-9]{{1,4}}(?:{SP}?(?:bis|ter))?,?{GAP}{spelled('rue avenue boulevard place chemin all[ée]e impasse quai')}(?:{GAP}[\p{{L}}'’-]+){{1,5}}?(?={SP}*(?:,|\n|\z)|{GAP}[0-9]{{5}})"
ABROAD = either(rf"{OPEN}{_GERMAN}", rf"(?<!\d){_FRENCH}")
ADDRESS = either(STREET, ABROAD)
STREET_ANCHORS = ("via", "v.le", "vle", "piazz", "p.z", "largo", "l.go", "corso", "c.so", "vico", "strad", "str.", "localit", "loc.", "fraz", "contrada", "c.da", "borgo", "lung", "riviera", "parco", "salita", "calle", "campo", "traversa", "circonvall", "traße", "strasse", "weg", "platz", "gasse", "allee", "ring", "rue", "avenue", "boulevard", "place", "chemin", "allée", "impasse", "quai")
PROPERTY = spelled("sit[oaie] ubicat[oaie] abitazione abitativ[oa]")
#: Personal cues of an address, which may stand behind a town or a lawyer's name.
DWELLING = Reach(rf"{OPEN}(?:{spelled('resident[ei] domiciliat[oaie] abitante dimorante studio')}|{PROPERTY}){SHUT}(?!\s+{fold('ex')}\s+{fold('lege', 'art')})", 240, rf";|{OPEN}{fold('sede')}{SHUT}|\n{SP}*\n|(?<=\p{{L}}{{5}})\.", ("resident", "domicili", "abita", "dimorant", "studio", "sit", "ubicat"))
DWELLING_MOST = 100  # characters between the cue and the address

# --- people by their evidence -------------------------------------------------------------------


class Seed(NamedTuple):
    source: str
    role: str
    pre: str
    core: str
    anchors: tuple[str, ...]
    single: bool = False  # one token is enough
    distinctive: bool = False  # needs a token that is no common word
    org_prone: bool = False  # names organisations as often as people
    given: bool = False  # one listed first name is enough
    ahead: bool = False  # a wrapped name ends at the evidence, not begins
    kind: str = ""  # private evidence: "strong", "block"; or "neutral", that judges have too


_NOT_ROLE = "".join(rf"(?<!{fold(w)}{b})" for w in ("consigliere", "relatore", "presidente", "giudice") for b in (r"\s{1,3}", r":\s{0,3}"))
COUNSEL = rf"{OPEN}{_NOT_ROLE}{fold(r'avv[.]?t[oi][.]?', r'avv[.](?:ti)?', 'avvocat[oaie]', 'avvocatessa')}(?!\s+{fold('general[ei]')}){maybe(SP + '*' + fold(r'prof[.]', r'dott[.](?:ssa)?'))}"
DEFENDER = rf"{OPEN}(?:{fold('difens(?:ore|ori|rice)')}|{fold('procuratore')}\s+{fold('speciale', 'domiciliatario')})(?:\s+{fold('di')}\s+{fold('fiducia')}|\s+{fold('d')}['’]{fold('ufficio')})?(?:\s+{fold('dell[ao]', 'di', 'del')})?"
_SIDE = rf"(?:\s+(?:{fold('i')}\s+)?{fold('signori', 'sigg?[.]?[^\\S\\n]?(?:ri|re|ra|r)?[.]?')})?"
APPLICANT = rf"{OPEN}(?:{fold('propost[oaie]', 'promoss[oaie]', 'presentat[oaie]')}\s+{fold('da(?:l|lla|i|gli|lle)?')}{SHUT}|{spelled('ricorso_di')}{SHUT}){_SIDE}"
COUNTERPARTY = rf"{OPEN}(?:{spelled('nei_confronti')}(?:\s+{fold('di')}{SHUT}|(?={SP}*\n))|{fold('contro')}(?={SP}*:?{SP}*\n)){_SIDE}"
BOTH = rf"{OPEN}{fold('vertent[ei]')}\s+{fold('tra', 'fra')}{SHUT}{_SIDE}"
PARTY = spelled("ricorrent[ei] resistent[ei] controricorrent[ei] appellant[ei] appellat[oaie] intimat[oaie] opponent[ei] oppost[oaie] att(?:ore|rice|ori) convenut[oaie] contribuent[ei] istant[ei] reclamant[ei]")
PENAL = spelled("imputat[oaie] indagat[oaie] condannat[oaie] assolt[oaie] parte_civile persona_offesa testimon[ei] teste denunciat[oaie] querelat[oaie]")
CAPACITY = rf"(?:{fold('soci[oa]')}(?:\s+{fold('accomandatari[oa]', 'unic[oa]')})?|{fold('amministrat(?:ore|rice|ori)')}(?:\s+{fold('unic[oa]', 'delegat[oa]')})?|{spelled('titolar[ei] legale_rappresentante ered[ei] coniuge curat(?:ore|rice) liquidat(?:ore|rice) tut(?:ore|rice)')}(?:\s+{fold('di')}{SHUT})?|{spelled('ditta impresa societ[àa]')}\s+{fold('di')}|{fold('s[.]?a[.]?s[.]?', 's[.]?n[.]?c[.]?')}\s+{fold('di')}|{spelled('ditta impresa')}\s+{fold('individuale')}(?:\s+{fold('di')})?|{spelled('studio_legale')})"
#: What follows a person's name in the heading of a document.
CLAUSE = rf"(?:\s*,\s*|\s*[-–]\s*|\s*\(|\s+)(?:{spelled('ivi già quivi attualmente')}\s+)?(?:{spelled('nat[oa] residente dimorante')}{SHUT}|{fold('domiciliat[oa]')}{SHUT}(?!\s+{fold('ex')}\s+{fold('lege')})|{fold('c[.]?')}\s?{fold('f[.]?')}{SHUT}|{spelled('codice_fiscale')}{SHUT}|{fold('p[.]?')}\s?{fold('iva')}{SHUT}|{spelled('partita_iva in_proprio quale_erede in_qualità_di')}{SHUT}|{fold('rappresentat[oaie]')}\s+{fold('e')}\s+{fold('difes[oaie]')}{SHUT})"
CLAUSE_ANCHORS = ("nat", "resident", "dimorant", "domiciliat", "c.f", "cf", "c. f", "codice", "iva", "in proprio", "quale", "qualità", "rappresentat")
_FISCAL = rf"\s*[(\[,–-]?\s*(?:(?:{fold('c[.]?')}\s?{fold('f[.]?')}|{fold('cod(?:ice|[.])?')}\s+{fold('fisc(?:ale|[.])?')})[\s:.n°]*)?{TAX_CODE}(?![\p{{L}}\p{{N}}])"
_ALONE = rf"(?!{TITLED}|{LAWYER}){NAME}(?![\p{{L}}'’]|{GAP}\p{{Lu}}|\.\s*[\p{{Ll}}\d])"
_KIN = spelled("figli[oa] fratello sorella padre madre marito moglie nipote cugin[oa] nonn[oa] zi[oa] coniuge my_(?:brother|sister|son|daughter|husband|wife|father|mother)")
SEEDS = [
    Seed("regex:cf_adiacente", "Nominativo", "", rf"{WRAPPED}(?={_FISCAL})", (), ahead=True, kind="strong"),
    Seed("regex:counsel", "Difensore", rf"(?:{COUNSEL}|{DEFENDER})\s*", WRAPPED, ("avv", "difens", "procurator"), kind="strong"),
    Seed("regex:difeso_da", "Difensore", rf"{OPEN}{spelled('difes[oaie] rappresentat[oaie] assistit[oaie] patrocinat[oaie]')}\s+(?:{fold('e')}\s+{spelled('difes[oaie] rappresentat[oaie] assistit[oaie]')}\s+)?(?:{fold('dall')}['’]\s*|{fold('da(?:l|lla|gli|i|lle)?')}\s+)(?:{COUNSEL}\s*|{fold('procurator[ei]')}\s+)?", WRAPPED, ("difes", "rappresentat", "assistit", "patrocinat"), kind="strong"),
    Seed("regex:titolo", "Nominativo", rf"{OPEN}{TITLED}\s*", FULL, ("sig", "dott", "dr.", "ing.", "prof", "geom.", "arch.", "rag.", "not"), kind="neutral"),
    Seed("regex:biografico", "Nominativo", OPEN, rf"{FULL}(?={CLAUSE})", CLAUSE_ANCHORS, org_prone=True, kind="strong"),
    Seed("regex:pki_firma", "Nominativo", rf"{OPEN}{fold('firmat[oa]')}\s+(?:{fold('digitalmente')}\s+)?{fold('da')}\s*:\s*", rf"{WRAPPED}(?=\s+{fold('emesso')})", ("firmat",)),
    Seed("regex:party_role", "Ricorrente", rf"{OPEN}{PARTY}[\s,:]+", FULL, ("ricorrent", "resistent", "appella", "intimat", "opponent", "oppost", "attor", "attric", "convenut", "contribuent", "istant", "reclamant"), kind="strong"),
    Seed("regex:qualifica", "Nominativo", rf"{OPEN}{CAPACITY}[\s,:]+", FULL, ("soci", "amministrat", "titolar", "legale", "ered", "coniuge", "curat", "liquidat", "tut", "ditta", "impresa", "s.a.s", "sas", "s.n.c", "snc"), kind="strong"),
    Seed("regex:proposto_da", "Ricorrente", rf"{APPLICANT}\s*:?\s*", FULL, ("propost", "promoss", "presentat", "ricorso"), kind="strong"),
    Seed("regex:nei_confronti", "Resistente", rf"{COUNTERPARTY}\s*:?\s*", FULL, ("confronti", "contro"), org_prone=True, kind="strong"),
    Seed("regex:email_display_name", "Nominativo", rf"(?m)^{SP}*(?:{spelled('from to cc da a mittente destinatari[oa]')}|{spelled('inviato_da')}){SP}*:{SP}*\"?", rf"\p{{L}}[\p{{L}}'’-]+(?:{GAP}\p{{L}}[\p{{L}}'’-]+){{1,3}}(?=\"?{SP}*<[^<>\s]+@)", ("@",), distinctive=True),
    Seed("regex:counsel_surname", "Difensore", rf"{COUNSEL}\s*", rf"{NAME}(?!{GAP}\p{{Lu}}|[\p{{L}}'’])", ("avv",), single=True, distinctive=True, kind="strong"),
    Seed("regex:titolo_solo", "Nominativo", rf"{OPEN}(?:{COURTESY}|{PROFESSION})\s*", _ALONE, ("sig", "ing.", "geom.", "arch.", "rag."), single=True, distinctive=True, kind="neutral"),
    Seed("regex:party_role_solo", "Ricorrente", rf"{OPEN}{PARTY}[\s,:]+", _ALONE, ("ricorrent", "resistent", "appella", "intimat", "opponent", "oppost", "attor", "attric", "convenut", "contribuent", "istant", "reclamant"), single=True, distinctive=True),
]
#: Relatives, whose names may be written in lower case if they are listed.
KIN = Seed("regex:parentela", "Nominativo", rf"{OPEN}{_KIN}(?:{GAP}{fold('minor(?:e|enne)', 'maggiore', 'primogenit[oa]')})?{GAP}", rf"\p{{L}}[\p{{L}}'’]++(?:{GAP}{NAME}){{0,2}}", ("figli", "fratello", "sorella", "padre", "madre", "marito", "moglie", "nipote", "cugin", "nonn", "zi", "coniuge", "my "), single=True, given=True)
#: Salutations, and closings with a first name at the end of the line.
GREETING = rf"{OPEN}{spelled('car[oa] carissim[oa] gentil(?:e|issim[oa]) ciao dear hi')}{GAP}"
GREETED = [
    (rf"{GREETING}(?!{TITLED}|{LAWYER})", rf"{NAME}(?={SP}*[,!:])", ("car", "gentil", "ciao", "dear", "hi ")),
    (rf"{OPEN}(?:{spelled('saluti salutoni cordialmente grazie regards best a_presto un_abbraccio')}|{fold('un')}\s+(?:{fold('caro')}\s+)?{fold('saluto')}){SP}*[,!.]?(?:{SP}*\n(?:{SP}*\n)?{SP}*|{GAP})", rf"\p{{L}}[\p{{L}}'’]++(?={SP}*(?:\n|\z))", ("salut", "cordial", "abbraccio", "presto", "grazie", "regards", "best")),
]
_AND = rf"\s*[,;]?\s*{fold('ed?')}(?:{GAP}{either('da', 'dal', 'dalla', 'dallo', 'dai', 'dagli', 'dalle', 'di')})?(?:{GAP}|{SP}*\n{SP}*)"
_WITHIN = rf"{SP}*\n?{SP}*"  # a list wraps, but not past an empty line
_ITEMS = rf"{FULL}(?:{_WITHIN}[,;]{_WITHIN}{FULL})*+(?:{_AND}{FULL})?"


class NameList(NamedTuple):
    source: str
    role: str
    pre: str
    core: str
    anchors: tuple[str, ...]


#: Lists behind one cue.
LISTS = [
    NameList("regex:counsel_list", "Difensore", rf"{COUNSEL}\s*", _ITEMS, ("avv",)),
    NameList("regex:party_list", "Ricorrente", rf"{APPLICANT}\s*:?\s*", _ITEMS, ("propost", "promoss", "presentat", "ricorso")),
    NameList("regex:party_list", "Resistente", rf"{COUNTERPARTY}\s*:?\s*", _ITEMS, ("confronti", "contro")),
    NameList("regex:party_list", "Nominativo", rf"{BOTH}\s*:?\s*", _ITEMS, ("vertent",)),
]
#: A block behind a cue whose names stand in capitals.
PARTY_BLOCK = (rf"{OPEN}(?:{spelled('propost[oa]_da nei_confronti_di')}|{fold('contro')}){SHUT}\s*:?\s*", rf"(?s).{{1,700}}?(?=\n\s*[-–]\s*{PARTY}|{OPEN}{spelled('avverso fatti_di_causa rilevato ritenuto svolgimento motivi vista_la_proposta udita_la_relazione')}{SHUT}|\z)", ("propost", "confronti", "contro"))
CAPITALS = r"(?<!\p{L})\p{Lu}[\p{Lu}'’]+(?:[^\S\r\n]+\p{Lu}[\p{Lu}'’.&]+)*(?!\p{L})"
CAPITAL_NAME = r"(?<!\p{L})\p{Lu}[\p{Lu}'’]{2,}(?:\s+\p{Lu}[\p{Lu}'’]+){1,3}(?!\p{L})"

PLACE_CUE = rf"{OPEN}(?:{fold('nat[oaie](?:/[oaie])?')}(?:\s+{fold('il')}\s+[\d./-]+)?|{fold('resident[ei]')}|{fold('dimorant[ei]')})\s*,?\s+{fold('ad?', 'in')}\s+"
PLACE = rf"\p{{Lu}}[\p{{L}}'’-]*(?:{GAP}[\p{{L}}'’-]+){{0,4}}"
PLACE_ANCHORS = ("nat", "resident", "dimorant")
_LINK = either("d(?:i|el|ella|ei|egli|elle)", "e", "&")
COMPANY = rf"{OPEN}(?:{NAME}|{_LINK})(?:{GAP}(?:{NAME}|{_LINK})){{0,6}}{GAP}{SUFFIX}"
COMPANY_SHAPE = rf"\s{SUFFIX}"
#: A company that bears people's names: a word for a family, or two surnames joined.
FAMILY = rf"{OPEN}(?:{spelled('fratelli eredi')}|{fold('f')}\s?\.?\s?{fold('lli')}\.?){SHUT}"
BRIDGE = rf"(?:{GAP}(?:{NAME}|[A-Z]\.|{_LINK}))*{SP}?$"
#: Endings of surnames: vowels and the consonants of usual suffixes.
SURNAME_ENDS = rf"(?:[aeiou](?:tt|ll|cc)i|[aeiou]zzi|[aiou]ni|(?:ar|al)di|[eo]ri|[ei]si|[cg]hi|sc[ao]|lino|nello)"
PAIR = rf"^\p{{Lu}}[\p{{L}}'’]*{SURNAME_ENDS}'?\s+(?:e|E|&)\s+\p{{Lu}}[\p{{L}}'’]*{SURNAME_ENDS}'?\s"

INITIALS = rf"(?<![\p{{L}}\p{{N}}._-]){DOTTED}(?![\p{{L}}\p{{N}}_])"
_DOTTED_LIST = rf"{DOTTED}(?:{_WITHIN}[,;]{_WITHIN}{DOTTED})*+(?:{_AND}{DOTTED})?"
#: Cues of initials: (role, pre, core).
INITIALS_CUES = [
    ("Ricorrente", rf"(?:{APPLICANT}\s*:?\s*|{OPEN}{PARTY}[\s,:]+)", _DOTTED_LIST),
    ("Resistente", rf"{COUNTERPARTY}\s*:?\s*", _DOTTED_LIST),
    ("Difensore", rf"{COUNSEL}\s+", _DOTTED_LIST),
    ("Nominativo", rf"{OPEN}(?:{TITLED}\s*|(?:{CAPACITY}|{PENAL}|{fold('minore')})(?:\s+{fold('di', 'della?')})?[\s:,]+)", _DOTTED_LIST),
    ("Nominativo", OPEN, rf"{DOTTED}(?={CLAUSE})"),
]
REFERENCE_BEFORE = rf"(?:(?<![\p{{L}}.]){fold('artt?[.]?', 'nn?[.]', 'cass[.]?', 'sez[.]?', 'sent[.]?', 'comma', 'commi', 'ex', 'cfr[.]?', 'rv[.]?')}{SP}*[:,-]?{SP}*|\d{SP}*)$"
REFERENCE_AFTER = rf"^(?:{SP}*(?:{fold('nn?[.]', 'n°', 'cit[.]')}|\d|/|:|{fold('del')}\s+\d)|\s*(?:[0-9]{{1,4}}{GAP}{_MONTH}|\d+/\d))"
ROLE_BEFORE = rf"{JUDICIAL}(?:{SP}*(?:{TITLED}|{LAWYER}))*{SP}*[:,-]?{SP}*$"

#: Fixed values. Words that end a name: headings, and roles that follow one as often as they precede it.
HEADINGS = """fatti fatto causa diritto ritenuto rilevato considerato osserva svolgimento processo motivi motivazione decisione dispositivo
conclusioni premesso premessa massima ordinanza sentenza decreto p.q.m. pqm epigrafe udienza adunanza camera consiglio ricorrente
controricorrente resistente intimato appellante appellato avvocato avvocati avvocatessa difensore difensori presidente giudice relatore
consigliere consiglieri procuratore rappresentante magistrato magistrati cancelliere segretario perito consulente contribuente imputato
convenuto attore erede notaio avverso visto oggetto contro""".split()
#: Fixed values. Words that no name begins with, and that none ends with: it is a slice of something longer.
NO_HEAD = "delle degli dei per con su in ed e al alla ai agli nel nella sul sulla tra fra che non ha il lo le gli un una questo questa cui".split()
NO_TAIL = "il lo la le gli un una di del dello della dei degli delle da dal dalla de e ed per con su in a al alla ai agli nel nella".split()
PARTICLES = "da dal dalla de dei del della di la lo".split()
#: The words of the engine's own tags (fixed values).
RESERVED = "Ricorrente Resistente Difensore Rappresentante Nominativo Terzo Società Associazione Consorzio Banca Ditta CF Email Pec IVA Iban Telefono Targa Indirizzo Documento Data_nascita Luogo Numero Conto Albo".split()
