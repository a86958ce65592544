"""Small word lists, as parameters of the engine. Larger ones can be given in their place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 20_000  # values of a list

# Usual Italian first names.
FIRST_NAMES = """adele agnese alba alberto aldo alessandra alessandro alessia alessio alfonso alfredo alice andrea angela
angelo anna annalisa antonella antonio arianna aurora barbara beatrice benedetta bruno camilla carla carlo carmela carmine
caterina cecilia chiara claudia claudio corrado cristiano cristina damiano daniela daniele dario davide debora diego
domenico donatella edoardo elena eleonora elisa elisabetta emanuela emanuele emilia emilio enrico ettore eugenio eva
fabio fabrizio federica federico ferdinando filippo fiorella flavio franca francesca francesco franco gabriele gabriella
gaetano gennaro giacomo gianluca gianni giorgia giorgio giovanna giovanni giulia giuliana giuliano giulio giuseppe
giuseppina grazia graziella guido ilaria irene ivan laura leonardo letizia lidia lorenzo luca lucia luciano luigi luisa
manuela marco margherita maria mariangela marina mario marta martina massimiliano massimo matteo maurizio mauro michela
michele milena mirko monica nadia nicola nicoletta olga ornella paola paolo patrizia pasquale piero pietro raffaele
raffaella renato renata riccardo rita roberta roberto rocco rosa rosanna rosaria sabrina salvatore samuele sandra sandro
sara serena sergio silvia silvio simona simone sofia sonia stefania stefano teresa tiziana tommaso umberto valentina
valeria valerio vanessa veronica vincenzo vito vittoria vittorio""".split()

# Italian towns, regional and provincial capitals and some small ones, lower case.
TOWNS = """agrigento alessandria ancona aosta arezzo asti avellino bari belluno benevento bergamo biella bologna bolzano
brescia brindisi cagliari caltanissetta campobasso caserta catania catanzaro chieti como cosenza cremona crotone cuneo
enna fermo ferrara firenze foggia frosinone genova gorizia grosseto imperia isernia latina lecce lecco livorno lodi lucca
macerata mantova matera messina milano modena monza napoli novara nuoro oristano padova palermo parma pavia perugia
pesaro pescara piacenza pisa pistoia pordenone potenza prato ragusa ravenna rieti rimini roma rovigo salerno sassari
savona siena siracusa sondrio taranto teramo terni torino trapani trento treviso trieste udine varese venezia
verbania vercelli verona vicenza viterbo""".split()
TOWNS += ["ascoli piceno", "reggio calabria", "reggio emilia", "la spezia", "massa", "vibo valentia"]

# The twenty regions.
REGIONS = ["abruzzo", "basilicata", "calabria", "campania", "emilia-romagna", "friuli-venezia giulia", "lazio", "liguria", "lombardia", "marche", "molise", "piemonte", "puglia", "sardegna", "sicilia", "toscana", "trentino-alto adige", "umbria", "valle d'aosta", "veneto"]

# Words of legal prose that are no distinctive part of a name.
COMMON_WORDS = """a al alla anche ancora che come con contro cui da dal dalla dalle degli dei del della delle di dopo e ed era fra gli ha il in la le lo ma nel nella non
oggi ogni per poi prima quale quando quello questa questo se si sono sopra su sul sulla tra un una generale ieri
accertamento agenzia amministrazione appello atto avvocato avviso banca cassazione causa civile codice
comune consiglio conte contribuente controparte corte costa costituzione decisione decreto difesa diritto
documento entrate esposito fatto ferrari fonte fontana giudice giudizio giustizia grande imposta istanza legale leone
liquidazione lombardi luogo mare marino ministero monte motivo nota ordinanza organo parte penale piazza presidente
procura provincia pubblica ragione regione relatore ricorrente ricorso riva rosa rossi russo sentenza serra societa
spese stato strada torre tribunale ufficio udienza valle verde vigna villa via""".split()

# Dotted abbreviations of two and three capitals that are no person's initials.
SIGLE = """A.E. C.C. C.F. C.P. C.T. D.L. D.M. D.P. D.R. G.E. G.I. G.U. L.R. P.A. P.G. P.I. P.M. P.S. R.D. R.G. S.C. S.S.
S.U. T.U. U.E. A.S.L. A.T.I. C.D.A. C.D.S. C.P.A. C.P.C. C.P.P. C.S.M. C.T.P. C.T.R. C.T.U. D.I.A. D.P.R. G.I.P. G.O.T.
G.U.P. I.C.I. I.M.U. I.V.A. N.R.G. P.E.C. P.Q.M. R.E.A. R.G.N. S.P.A. S.R.L. T.A.R. T.U.F.""".split()


@dataclass(frozen=True)
class Lexicons:
    first_names: tuple[str, ...] = tuple(FIRST_NAMES)
    towns: tuple[str, ...] = tuple(TOWNS)
    regions: tuple[str, ...] = tuple(REGIONS)
    common_words: tuple[str, ...] = tuple(COMMON_WORDS)
    sigle: tuple[str, ...] = tuple(SIGLE)

    @classmethod
    def of(cls, **tables: DataFrame) -> Lexicons:
        """Own lists: a table of one string column for each, read on the driver. A list is part of the
        plan, so it is bounded by MOST values."""
        found = {}
        for name, df in tables.items():
            rows = df.select(F.col(df.columns[0]).alias("v")).filter("v is not null").distinct().limit(MOST + 1).collect()
            if len(rows) > MOST:
                raise ValueError(f"{name} has more than {MOST} values")
            found[name] = tuple(sorted(r["v"] if name == "sigle" else r["v"].lower() for r in rows))
        return cls(**found)
