"""Short texts that each reach one rule, and what the engine must make of them.

A probe is (text, expected output): a template of invented names, which SQL fills in as Spark does,
so the expected rows need no detector. Negative cases have their text as the expected one. Where a
rule acts, its tag stands in the expected text. Each customer gets one probe of a family, and names
by its key; most first names are in no list, so that only the rule under test can find the person.
"""

from __future__ import annotations

from .functions.checks import tax_code_check

GIVEN = ["Ildebrando", "Callisto", "Dorotea", "Fulgenzio", "Ersilia"]  # in no list
LISTED = ["Lucia", "Paolo", "Chiara", "Sergio"]  # first names that the lexicon has
SURNAMES = ["Brustolandi", "Cervigatti", "Dondarelli", "Fregolazzi", "Ghiozzani", "Lumachetti", "Quagliotto", "Sferracani", "Tramontozzi", "Zuffalini", "Bramazza"]
TOWNS = ["Lodi", "Treviso", "Ancona", "Ravenna"]
HOMES = ["Roma", "Milano", "Torino"]


def _code(body: str) -> str:
    return body + tax_code_check(body)


TAX_CODES = [_code(c) for c in ("RSSMRA80A01H501", "BNCLCU75C41F205", "VRDNNA62T55L219", "NRIGPP90E10A662")]
SWAPPED = [_code(c) for c in ("RSSMRA80A01H50M", "BNCLCU75C41F2LR", "VRDNNA62T55LNMV", "NRIGPP90EM0A66N")]  # letters for digits


def iban(country: str, rest: str) -> str:
    digits = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{country}{98 - int(digits) % 97:02d}{rest}"


IBANS = [iban("IT", f"X05428111010000001{n:05d}") for n in (23456, 34567, 45678)]
FOREIGN = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in (iban("DE", "370400440532013000"), iban("DE", "500105175407324931"))]

#: Columns that templates name: people P, Q (parties), C (counsel), J (judge) of unlisted first names,
#: G of a listed one; with G the given name, S the surname, U in capitals and surname first, L in lower case.
_PEOPLE = {"P": (GIVEN, 0, 0), "Q": (GIVEN, 2, 3), "C": (GIVEN, 1, 5), "J": (GIVEN, 3, 7), "G": (LISTED, 0, 9)}


def _columns(pick) -> dict[str, str]:
    out = {}
    for k, (given, a, b) in _PEOPLE.items():
        g, s = pick(given, a), pick(SURNAMES, b)
        out |= {k: f"{g} || ' ' || {s}", k + "G": g, k + "S": s, k + "U": f"upper({s} || ' ' || {g})", k + "L": f"lower({g} || ' ' || {s})", k + "SU": f"upper({s})", k + "SL": f"lower({s})"}
    code = pick(TAX_CODES, 0)
    spaced = " || ' ' || ".join(f"substr(lower({code}), {a}, {n})" for a, n in ((1, 3), (4, 3), (7, 5), (12, 5)))
    out |= {"TOWN": pick(TOWNS, 0), "CF": code, "CFO": pick(SWAPPED, 1), "CFS": spaced, "CFX": f"lower(substr({code}, 1, 15)) || CASE WHEN substr({code}, 16, 1) = 'A' THEN 'b' ELSE 'a' END", "IBAN": pick(IBANS, 0), "IBANF": pick(FOREIGN, 0)}
    out |= {"HOME": pick(HOMES, 0), "NUM": "CAST(c_custkey % 90 + 1 AS STRING)", "EMAIL": "'u' || CAST(c_custkey AS STRING) || '@example.org'", "PHONE": "'011 ' || CAST(4000000 + c_custkey AS STRING)"}
    return out


def duck(values: list[str], shift: int) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST((c_custkey + {shift}) % {len(values)} AS INT) + 1]"


def spark(values: list[str], shift: int) -> str:
    return f"array({', '.join(repr(v) for v in values)})[CAST((c_custkey + {shift}) % {len(values)} AS INT)]"


def quoted(text: str, dialect) -> str:
    if dialect is spark:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


def filled(template: str, dialect) -> str:
    """SQL of a template with its names in place."""
    columns = _columns(dialect)
    parts, at = [], 0
    while (i := template.find("{", at)) >= 0:
        j = template.index("}", i)
        if i > at:
            parts.append(quoted(template[at:i], dialect))
        parts.append(f"({columns[template[i + 1 : j]]})")
        at = j + 1
    if at < len(template) or not parts:
        parts.append(quoted(template[at:], dialect))
    return " || ".join(parts)


def chosen(values: list[str], dialect) -> str:
    """SQL of the value of a customer's probe."""
    return f"CASE c_custkey % {len(values)} " + " ".join(f"WHEN {i} THEN {filled(v, dialect)}" for i, v in enumerate(values)) + " END"


def same(*texts: str) -> list[tuple[str, str]]:
    """Probes that change nothing."""
    return [(t, t) for t in texts]


STRUCTURED = [
    ("Codice {CF} agli atti.", "Codice CF_1 agli atti."),
    ("Codice {CFO} agli atti.", "Codice CF_1 agli atti."),
    ("codice {CFS} agli atti.", "codice CF_1 agli atti."),
    ("P. IVA 01234567890 agli atti.", "P. IVA IVA_1 agli atti."),
    ("partita iva n. 01234567890 e c.f./p.iva 09876543210.", "partita iva n. IVA_1 e c.f./p.iva IVA_2."),
    ("Iban {IBAN} del conto.", "Iban Iban_1 del conto."),
    ("Iban {IBANF}, del conto.", "Iban Iban_1, del conto."),
    ("Scrive a {PSL}@legalmail.it e {QSL}@pec.ordine.example.it oggi.", "Scrive a Pec_1 e Pec_2 oggi."),
    ("Scrive a {PSL}@example.org oggi.", "Scrive a Email_1 oggi."),
    ("Scrive a paolo.{QSL}@agenziaentrate.it oggi.", "Scrive a Email_1 oggi."),
    ("Chiama tel. 011 4478230 oggi.", "Chiama tel. Telefono_1 oggi."),
    ("Chiama +39 011 4478230 oggi.", "Chiama Telefono_1 oggi."),
    ("Mostra la carta d'identità n. AB1234567 e il passaporto YA7654321.", "Mostra la carta d'identità n. Documento_1 e il passaporto Documento_2."),
    ("Mostra la C.I. CA12345AA rilasciata ieri.", "Mostra la C.I. Documento_1 rilasciata ieri."),
    ("Paga sul conto corrente n. 123456789 e sul c/c postale 7654321.", "Paga sul conto corrente n. Conto_1 e sul c/c postale Conto_2."),
    ("Iscritto all'albo degli avvocati del foro al n. 1234 da anni.", "Iscritto all'albo degli avvocati del foro al n. Albo_1 da anni."),
    ("Veicolo targato AB 123 CD in sosta.", "Veicolo targato Targa_1 in sosta."),
    ("Nato il 3 aprile 1960, tace.", "Nato il Data_nascita_1, tace."),
    ("Nata a {TOWN} il 03/04/1960, tace.", "Nata a Luogo_1 il Data_nascita_1, tace."),
    ("Nato il tre aprile millenovecentosessanta, tace.", "Nato il Data_nascita_1, tace."),
    ("Nata a {TOWN} (LO) l'1.2.1970, tace.", "Nata a Luogo_1 (LO) l'Data_nascita_1, tace."),
    ("Nato a {TOWN}, Prov. LO, il 3.4.1960, tace.", "Nato a Luogo_1, Prov. LO, il Data_nascita_1, tace."),
    ("Nata a {TOWN} (3.4.1960), tace.", "Nata a Luogo_1 (Data_nascita_1), tace."),
    *same(
        "codice {CFX} agli atti.", "Il protocollo 01234567890 agli atti.", "Codice DE00 3704 0044 0532 0130 00 errato.", "Scrive a protocollo@comune.lodi.it oggi.",
        "Il numero 011 4478230 agli atti.", "Iscritto all'ordine degli architetti con delibera n. 1234 di ieri.", "Sentenza depositata il 3.4.1960 in aula.", "La pratica 123456789 agli atti.",
    ),
]
_DECIDES = " Poi l'ing. {J} decide."  # a title that speaks for no role
JUDGES = [
    (f"Oggi.{_DECIDES}", "Oggi. Poi l'ing. Nominativo_1 decide."),
    ("Presidente: {J}\nIl ricorrente {J} insiste.", "Presidente: Nominativo_1\nIl ricorrente Nominativo_1 insiste."),
    ("Presidente: Tribunale Ordinario\nPoi l'ing. {J} decide.", "Presidente: Tribunale Ordinario\nPoi l'ing. Nominativo_1 decide."),
    ("composta dai magistrati {J}; nel giudizio.\nPoi l'ing. {Q} tace.", "composta dai magistrati {J}; nel giudizio.\nPoi l'ing. Nominativo_1 tace."),
    *same(
        *(t + _DECIDES for t in (
            "Relatore: {J}\n", "Presidente: {JU} Relatore: {QU}\n", "G.I. {J} in aula.", "(Pres. ed Est. {J}) in aula.", "Udita la relazione svolta dal consigliere {J}.", "il consigliere\nrelatore {J} riferisce.",
            "Sostituto procuratore generale {J}.", "{J}, Presidente e Relatore\n", "Sono presenti {J} - Presidente - e altri.", "il Presidente dott. {J} apre.",
            "CONCLUSIONI DELL'AVVOCATO GENERALE\n{J}\n", "Così deciso.\nIl Presidente\n\n{J}\n", "il Cons. {J} riferisce.", "il referendario {J} riferisce.",
            "nella persona del Giudice unico {J} in aula.", "Relatore nella camera di consiglio del giorno 5 novembre 2025 la dott.ssa {J} presente.",
            "la requisitoria del dott. {J}, Sostituto Procuratore generale.", "composta dai magistrati:\n{J}\n{Q}\nha pronunciato.", "composta dai magistrati\n{J}   Presidente\nha pronunciato.",
            "ha pronunciato la presente SENTENZA {Q}, Presidente, {J}, {P}, Consigliere\n", "Giudice: avv. {J}\n",
        )),
    ),
]
SEEDS = [
    ("{P} ({CF}) compare.", "Nominativo_1 (CF_1) compare."),
    ("Per parte l'avv. {C} deposita.", "Per parte l'avv. Nominativo_1 deposita."),
    ("Il difensore {C} deposita.", "Il difensore Nominativo_1 deposita."),
    ("Il procuratore speciale {C} deposita.", "Il procuratore speciale Nominativo_1 deposita."),
    ("La parte, rappresentata e difesa da {C}, deposita.", "La parte, rappresentata e difesa da Nominativo_1, deposita."),
    ("La parte, patrocinata dal procuratore {C}, deposita.", "La parte, patrocinata dal procuratore Nominativo_1, deposita."),
    ("Sentito l'ing. {P} in aula.", "Sentito l'ing. Nominativo_1 in aula."),
    ("Sentita la sig.ra {P} in aula.", "Sentita la sig.ra Nominativo_1 in aula."),
    ("Vista {P}, in proprio, e domiciliata in casa.", "Vista {P}, in proprio, e domiciliata in casa.".replace("Vista {P}", "Nominativo_1")),
    ("poi {P}, ivi residente, insiste.", "poi Nominativo_1, ivi residente, insiste."),
    ("poi {P} - P.IVA 01234567890 insiste.", "poi Nominativo_1 - P.IVA IVA_1 insiste."),
    ("poi {P}, rappresentato e difeso come in atti.", "poi Nominativo_1, rappresentato e difeso come in atti."),
    ("Firmato da: {P} emesso ieri.", "Firmato da: Nominativo_1 emesso ieri."),
    ("Il controricorrente {P} deduce.", "Il controricorrente Nominativo_1 deduce."),
    ("Gli intimati {P} e altri tacciono.", "Gli intimati Nominativo_1 e altri tacciono."),
    ("il socio accomandatario {P} tace.", "il socio accomandatario Nominativo_1 tace."),
    ("la ditta individuale {P} tace.", "la ditta individuale Nominativo_1 tace."),
    ("lo studio legale {C} tace.", "lo studio legale Nominativo_1 tace."),
    ("Ricorso proposto da {P} per la riforma.", "Ricorso proposto da Nominativo_1 per la riforma."),
    ("Agisce nei confronti di {P} per danni.", "Agisce nei confronti di Nominativo_1 per danni."),
    ("ricorre contro\n{P}\nper danni.", "ricorre contro\nNominativo_1\nper danni."),
    ("Mittente: {PL} <x@example.org>\n", "Mittente: Nominativo_1 <Email_1>\n"),
    ("difesi dagli avvocati {C}, {P} e {Q}, insistono.", "difesi dagli avvocati Nominativo_1, Nominativo_2 e Nominativo_3, insistono."),
    ("causa vertente tra {P} e {Q} in aula.", "causa vertente tra Nominativo_1 e Nominativo_2 in aula."),
    ("ricorso proposto da {P}; {Q} e da {C}, insieme.", "ricorso proposto da Nominativo_1; Nominativo_2 e da Nominativo_3, insieme."),
    ("Conclude l'avv. {CS} in aula.", "Conclude l'avv. Nominativo_1 in aula."),
    ("Insiste il sig. {PS} in aula.", "Insiste il sig. Nominativo_1 in aula."),
    ("Insiste il ricorrente {PS} in aula.", "Insiste il ricorrente Nominativo_1 in aula."),
    ("ricorso contro BANCA NAZIONALE e {PU}, AVVERSO la decisione", "ricorso contro BANCA NAZIONALE e Nominativo_1, AVVERSO la decisione"),
    ("con il figlio minore {PG} a carico.", "con il figlio minore Nominativo_1 a carico."),
    ("con mio figlio paolo a carico.", "con mio figlio Nominativo_1 a carico."),
    ("Caro Paolo,\nti scrivo.", "Caro Nominativo_1,\nti scrivo."),
    ("Ti scrivo.\nCordialmente,\nPaolo", "Ti scrivo.\nCordialmente,\nNominativo_1"),
    ("Ieri {G} era presente.", "Ieri Nominativo_1 era presente."),
    ("In atti {GU} era presente.", "In atti Nominativo_1 era presente."),
    ("Ieri {GG} Della {GS} era presente.", "Ieri Nominativo_1 era presente."),
    ("Ieri {GG} Maria {GS} era presente.", "Ieri Nominativo_1 era presente."),
    *same(
        "Ieri {P} era presente.", "ricorre contro {P} senza motivo.", "con la moglie separata a carico.", "Caro Collega,\nti scrivo.", "abita in Viale {G} da anni.", "visto l'Ospedale di {G} in zona.",
        "Il Comune di {P}, rappresentato e difeso come in atti.", "la parte, domiciliata ex lege, insiste.",
    ),
]
SEEDS[8] = ("poi {P}, in proprio, e domiciliata in casa.", "poi Nominativo_1, in proprio, e domiciliata in casa.")
GUARDS = [
    ("Insiste l'avv. {C}\nFATTI DI CAUSA", "Insiste l'avv. Nominativo_1\nFATTI DI CAUSA"),
    ("Insiste l'avv. {CG}\n{CS} in aula.", "Insiste l'avv. Nominativo_1 in aula."),
    ("Difeso dall'avv. {C}\nIl ricorrente insiste.", "Difeso dall'avv. Nominativo_1\nIl ricorrente insiste."),
    ("Difeso dall'avv. {C}\nSegretario: assente.", "Difeso dall'avv. Nominativo_1\nSegretario: assente."),
    ("il teste\n{PG}\n{PS} ({CF}) tace.", "il teste\nNominativo_1 (CF_1) tace."),
    ("visto {GU}\n{PS} insiste.", "visto Nominativo_1\n{PS} insiste."),
    *same(
        "Il ricorrente Ministero Interno insiste.", "Il ricorrente Condominio Aurora insiste.", "Agisce nei confronti di Polizia Locale per danni.", "Il ricorrente I.N.P.S. Sede insiste.", "Il ricorrente Cooperativa Azzurra insiste.",
        "Il ricorrente Alfa Srl insiste.", "Il ricorrente Via {PS} insiste.", "Il ricorrente Con Riserva insiste.", "Il ricorrente Tutto Per insiste.", "Il ricorrente Nominativo_1 insiste.", "Il ricorrente Terzo Nominativo insiste.",
        "Conclude l'avv. Causa in aula.", "Insiste il sig. Presidente in aula.", "Agisce nei confronti di {P} S.p.A. per danni.", "Agisce nei confronti di Banca {P} per danni.", "vista la chiesa di San {GG} {GS} in zona.",
    ),
]
PROPAGATION = [
    ("Insiste il sig. {PS} oggi. Il ricorrente {P} insiste.", "Insiste il sig. Nominativo_1 oggi. Il ricorrente Nominativo_1 insiste."),
    ("Il ricorrente {P} insiste. Visto {PU}; vista {P}.", "Il ricorrente Nominativo_1 insiste. Visto Nominativo_1; vista Nominativo_1."),
    ("Il ricorrente {P} insiste. La {PS} e {PSU} tacciono; {PSL} no.", "Il ricorrente Nominativo_1 insiste. La Nominativo_1 e Nominativo_1 tacciono; {PSL} no."),
    ("La sig.ra {PG} {PS} e il sig. {QG} {PS} compaiono. Poi {PS} insiste.", "La sig.ra Nominativo_1 e il sig. Nominativo_2 compaiono. Poi Nominativo_3 insiste."),
    ("Scrive l'avv. Rosa {GS} oggi. Oggi scrive anche Rosa, sola.", "Scrive l'avv. Nominativo_1 oggi. Oggi scrive anche Nominativo_1, sola."),
    ("Scrive l'avv. Rosa {GS} oggi. Oggi abita in via Rosa, sola.", "Scrive l'avv. Nominativo_1 oggi. Oggi abita in via Rosa, sola."),
    ("Il sig. {P} e il sig. {Q} tacciono; poi il sig. {Q} parla.", "Il sig. Nominativo_1 e il sig. Nominativo_2 tacciono; poi il sig. Nominativo_2 parla."),
    ("Il ricorrente {P} cita {P} c. Italia in atti.", "Il ricorrente Nominativo_1 cita {P} c. Italia in atti."),
    ("Il ricorrente {P} cita la causa C-348/16, {P} contro {Q} in atti.", "Il ricorrente Nominativo_1 cita la causa C-348/16, {P} contro {Q} in atti."),
    ("Scrive {PSL}@example.org e poi {PSL}@EXAMPLE.org, uguale.", "Scrive Email_1 e poi Email_1, uguale."),
]
ROLES = [
    ("Compare il sig. {P} oggi. Il ricorrente {P} insiste.", "Compare il sig. Ricorrente_1 oggi. Il ricorrente Ricorrente_1 insiste."),
    ("Agisce nei confronti di {P} per danni, difeso dall'avv. {C} oggi.", "Agisce nei confronti di Resistente_1 per danni, difeso dall'avv. Difensore_1 oggi."),
    ("ricorso contro BANCA NAZIONALE e {PU}, AVVERSO la decisione", "ricorso contro BANCA NAZIONALE e Resistente_1, AVVERSO la decisione"),
    ("causa vertente tra {P} e {Q} in aula.", "causa vertente tra Nominativo_1 e Nominativo_2 in aula."),
]
ADDRESSES = [
    ("residente in {TOWN}, Via Garibaldi 12, tace.", "residente in Luogo_1, Indirizzo_1, tace."),
    ("con studio in {TOWN}, corso Roma n. 42/B, tace.", "con studio in {TOWN}, Indirizzo_1, tace."),
    ("vende l'immobile sito in {TOWN}, Via Garibaldi 12, oggi.", "vende l'immobile sito in {TOWN}, Indirizzo_1, oggi."),
    ("Sig. {P}\nVia Lorenteggi, 157\n20146 MILANO", "Sig. Nominativo_1\nIndirizzo_1\n20146 MILANO"),
    ("in {TOWN}, Via Indipendenza n. 7, nel mio studio, oggi.", "in {TOWN}, Indirizzo_1, nel mio studio, oggi."),
    ("residente in {TOWN}, Via Garibaldi 12; presso l'Avvocatura.", "residente in Luogo_1, Indirizzo_1; presso l'Avvocatura."),
    ("residente a Monaco di Baviera, Sendlinger Straße 15, tace.", "residente a Monaco di Baviera, Indirizzo_1, tace."),
    ("residente in Francia, 14 rue des Martyrs, 75009 Paris, tace.", "residente in Francia, Indirizzo_1, 75009 Paris, tace."),
    ("Nato a Wenzhou (Repubblica Popolare Cinese), tace.", "Nato a Luogo_1 (Repubblica Popolare Cinese), tace."),
    ("Nata a {TOWN} da famiglia nota, tace.", "Nata a Luogo_1 da famiglia nota, tace."),
    ("domiciliato presso lo studio dell'avv. {C} in {TOWN}, viale Trento 3, tace.", "domiciliato presso lo studio dell'avv. Nominativo_1 in {TOWN}, Indirizzo_1, tace."),
    *same(
        "con sede in {TOWN}, Via Garibaldi 12, tace.", "nel corso del giudizio 12 parti tacciono.", "visto il Tribunale, sito in {TOWN}, Via Garibaldi 12, oggi.", "Spett.le\nAgenzia delle Entrate\nCorso Bolzano 30, 10121 Torino",
        "domiciliata in {TOWN}, via dei Portoghesi 12, presso l'Avvocatura generale dello Stato, tace.", "Nata a Castelvuoto, tace.", "Visita {TOWN} oggi.",
    ),
]
INITIALS = [
    ("Il ricorrente A.G. espone; poi A. G. insiste, oggi.", "Il ricorrente Nominativo_1 espone; poi Nominativo_1 insiste, oggi."),
    ("ricorso proposto da A.G. Il ricorso segue.", "ricorso proposto da Nominativo_1. Il ricorso segue."),
    ("ricorso proposto da A.G., Z.I. e da L.B. insieme.", "ricorso proposto da Nominativo_1, Nominativo_2 e da Nominativo_3 insieme."),
    ("tace l'imputato B.L. oggi.", "tace l'imputato Nominativo_1 oggi."),
    ("Il ricorrente A.G. e il Presidente dott. A.G. parlano.", "Il ricorrente Nominativo_1 e il Presidente dott. A.G. parlano."),
    ("Il ricorrente A.G. e poi A.G. {PS} parlano.", "Il ricorrente Nominativo_1 e poi A.G. {PS} parlano."),
    ("Il ricorrente A.G. cita l'art. 3 A.G. e tace.", "Il ricorrente Nominativo_1 cita l'art. 3 A.G. e tace."),
    ("Il ricorrente A.G. cita A.G. n. 7 e tace.", "Il ricorrente Nominativo_1 cita A.G. n. 7 e tace."),
    ("poi Z.T., ivi residente, tace.", "poi Nominativo_1, ivi residente, tace."),
    *same("Il ricorrente P.M. chiede.", "P.Q.M. rigetta.", "Secondo Z.T. nulla muta."),
]
EVERYWHERE = [
    ("Secondo Z.T. nulla muta.", "Secondo Nominativo_1 nulla muta."),
    ("Secondo Z.T. Il caso è noto.", "Secondo Nominativo_1. Il caso è noto."),
    *same("Cass. S.U. conferma.", "P.Q.M. rigetta.", "Secondo Z.T. {PS} nulla muta."),
]
COMPANIES = [
    ("paga la {PS} Costruzioni S.r.l. oggi.", "paga la Società_1 oggi."),
    ("paga la Fratelli {PS} S.n.c. oggi.", "paga la Società_1 oggi."),
    ("paga la {PS} Costruzioni S.r.l. di ieri e la {PS} COSTRUZIONI S.r.l. oggi.", "paga la Società_1 di ieri e la Società_1 oggi."),
    *same("paga la Equitalia Nord S.p.A. oggi.", "paga la Agenzia Nord S.p.A. oggi."),
]
NAMED_COMPANIES = [
    ("paga la Fratelli {PS} S.n.c. oggi.", "paga la Società_1 oggi."),
    ("paga la F.lli {PS} S.n.c. oggi.", "paga la Società_1 oggi."),
    ("paga la Bianchini e Morelli S.n.c. oggi.", "paga la Società_1 oggi."),
    ("pagano i fratelli {PS} Impianti S.r.l. oggi.", "pagano i Società_1 oggi."),
    *same("paga la {PS} Costruzioni S.r.l. oggi.", "paga la Luna e Sole S.r.l. oggi."),
]
#: Raw text and its normalised form, a step each.
MARKUP = [
    ("ﬁrma di {PS}", "firma di {PS}"),
    ("caff&egrave; di {PS} &#224; &lt;b", "caffè di {PS} à <b"),
    ("zero\u200blarghezza\u00ad di {PS}\ufeff", "zerolarghezza di {PS}"),
    ("iI tribuna|e di {PS} | no", "iI tribunale di {PS} | no"),
    ("Ma-\nrio di {PS}\ncon un lun-\nghis-\nsimo nome", "Mario di {PS}\ncon un lunghissimo nome"),
    (" -controricor-\nrente di {PS}", " -controricor-\nrente di {PS}"),
    ("x- \n y di {PS}", "x- \n y di {PS}"),
    ("---\ntitolo: x\n---\nTesto di {PS}", "Testo di {PS}"),
    ("+++\ntitolo = 1\n+++\nTesto di {PS}", "Testo di {PS}"),
    ("Prima <!-- nota\nlunga --> di {PS}", "Prima  di {PS}"),
    ("<p class=x><font size=2>Testo</font> <mark>di</mark> <del>{PS}</del><br/>", "Testo di {PS}"),
    ("disse <<basta>> a {PS} <ignoto> <main>", "disse <<basta>> a {PS} <ignoto> <main>"),
    ("![foto di {PS}](a.png) e [sito](http://x.it)", "foto di {PS} e sito"),
    ("**Ma**rio *di* `{PS}` e ****", "Mario di {PS} e ****"),
    ("__Testo__ di _{PS}_ e Tag_1 con Tag_2", "Testo di {PS} e Tag_1 con Tag_2"),
    ("      ## Titolo di {PS}\ntesto", "Titolo di {PS}\ntesto"),
    ("    > citato di {PS}\n> altro", "citato di {PS}\naltro"),
    ("D’Angelo “cita” {PS}", "D'Angelo \"cita\" {PS}"),
]
#: Texts, and what verification says: status, risk, residuals (kind and text) in order.
RESIDUALS = [
    ("poi {P} parla in aula.", "needs_review|0.7|PERSON {P} verification:name-shape"),
    ("tace il debitore {P} in aula.", "needs_review|0.7|PERSON {P} verification:name-shape"),
    ("Il ricorrente {P} insiste; {PSL} tace.", "needs_review|0.7|PERSON {PSL} verification:alias"),
    ("Presidente: {J}\nIl ricorrente {J} insiste.", "needs_review|0.5|"),
    ("Presidente: {J}\n" + "parola " * 3, "passed_checks|0.0|"),
    ("Il ricorrente {P} insiste.", "passed_checks|0.0|"),
    ("parola " * 310, "needs_review|0.7|DOCUMENT  verification:coverage"),
    ("parola " * 310 + "OMISSIS A.B. e OMISSIS", "passed_checks|0.0|"),
    ("poi la Banca Azzurra e il Comune Nuovo parlano.", "passed_checks|0.0|"),
    ("poi via Alfa Beta e Alfa Srl parlano.", "needs_review|0.7|PERSON Alfa Beta verification:name-shape"),
    ("FATTI DI CAUSA e MOTIVI DELLA DECISIONE", "passed_checks|0.0|"),
]
#: Texts, and what is kept as a procedural number or a case's name.
CASES = [
    ("Sentenza n. 12/2020 e R.G. n. 345/19 in atti.", "R.G. n. 345/19; n. 12/2020"),
    ("ruolo generale 77/2021, poi 15 / 2019, in atti.", "15 / 2019; ruolo generale 77/2021"),
    ("n. 3 / 21 e nn. 7/2018 in atti.", "n. 3 / 21; nn. 7/2018"),
    ("nato il 12/03/1974 in atti.", ""),
    ("ECLI:IT:CASS:2020:1234CIV in atti.", "ECLI:IT:CASS:2020:1234CIV"),
    ("come in {P} e altri c. Italia, in atti.", "{P}"),
    ("come in {PS} contro Regno Unito, in atti.", "{PS}"),
    ("come in {P} contro Italia Trasporti, in atti.", ""),
    ("causa C-348/16, {P} contro {Q}, in atti.", "{P} contro {Q}"),
    ("causa T-12/05 P, {PS}, in atti.", "{PS}"),
]
