"""Lists and thresholds that must equal the published rules."""

#: Reporting threshold of a payment, in SEK.
REPORTING_THRESHOLD = 150_000
#: Order of severities and of tiers, most severe first.
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}

# Word lists of the text signals. A word counts where it occurs as a substring of the lower-cased text.
FEAR_WORDS = ("rädd", "rädsla", "skräck", "orolig", "oro", "ångest", "panik", "fruktan", "hotad", "farlig", "fara", "risk", "osäker", "nervös", "ängslig", "bekymrad", "desperat", "hjälp")
VIOLENCE_WORDS = ("slå", "mörda", "döda", "skada", "misshandla", "våld", "våldsam", "blod", "kniv", "vapen", "pistol", "gevär", "skjuta", "attackera", "angripa", "hota", "hämnd", "straffa", "tortera", "kidnappa", "bränna", "explodera", "bomba")
URGENCY_WORDS = ("nu", "genast", "omedelbart", "snabbt", "fort", "brådskande", "akut", "måste", "tvungen", "deadline", "sista chansen", "snart", "idag", "ikväll", "strax")
THREAT_WORDS = ("om du inte", "annars", "konsekvenser", "ångra", "betala", "överför", "skicka pengar", "säg inget", "berätta inte", "hemlighet", "ingen får veta", "jag vet var", "jag hittar", "du kommer", "din familj", "dina barn", "ditt hus")
POSITIVE_WORDS = ("bra", "fantastisk", "utmärkt", "glad", "lycklig", "underbar", "perfekt", "fin", "trevlig", "positiv", "succé", "framgång", "vänlig", "vacker", "rolig")
NEGATIVE_WORDS = ("dålig", "hemsk", "fruktansvärd", "ledsen", "olycklig", "besviken", "fel", "misslyckad", "ful", "elak", "dum", "svår", "jobbig", "problematisk", "katastrof")
#: Weights of the four scores in the risk of a text.
SENTIMENT_WEIGHTS = {"violence": 0.35, "threat": 0.30, "fear": 0.20, "urgency": 0.15}

# Threat vocabulary, whole words by category and severity.
VOCABULARY = {
    "gang": {
        "gäng": "high", "gangster": "high", "kriminell": "medium", "brottsling": "medium", "liga": "medium", "bransen": "high", "gatan": "low",
        "adda": "medium", "hoppa av": "low", "brödraskapet": "high", "bandidos": "high", "hells angels": "high",
    },
    "drugs": {
        "narkotika": "medium", "knark": "high", "drog": "medium", "langare": "high", "langning": "high", "cannabis": "low", "marijuana": "low",
        "kokain": "high", "heroin": "high", "amfetamin": "high", "ecstasy": "medium", "gansen": "high", "bansen": "high", "tjansen": "high",
        "röansen": "medium", "pansen": "high", "kansen": "high", "bransen": "high",
    },
    "violence": {
        "skjutning": "high", "knivattack": "high", "misshandel": "high", "mord": "high", "dödshot": "high", "utpressning": "high",
        "kidnappning": "high", "tortyr": "high", "sprängning": "high", "bomb": "high", "vapen": "medium", "pistol": "high", "gevär": "high",
        "automatvapen": "high", "handgranat": "high", "lansen": "high", "buransen": "high", "knansen": "medium",
    },
    "money_laundering": {
        "penningtvätt": "high", "svarta pengar": "high", "kontant": "low", "bulvan": "high", "målvakt": "high", "skalbolag": "high",
        "brevlådeföretag": "high", "fakturaskojeri": "high", "överföring utomlands": "medium", "kryptovaluta": "low", "bitcoin": "low",
        "hawala": "high", "smurfa": "high", "splitta betalningar": "medium",
    },
    "fraud": {
        "bedrägeri": "high", "bluff": "medium", "scam": "high", "lurad": "medium", "förfalskning": "high", "id-kapning": "high",
        "identitetsstöld": "high", "kortbedrägeri": "high", "fakturaskojeri": "high", "ponzibedrägeri": "high", "pyramidspel": "medium",
        "insiderhandel": "high", "kursmanipulation": "high",
    },
    "slang": {
        "gansen": "low", "shansen": "low", "ansen": "low", "sansen": "low", "bansen": "low", "para": "low", "aina": "low", "wallah": "low",
        "akhi": "low", "habibi": "low", "yalla": "low", "shoo": "low",
    },
}

# Marks of a language, as substrings of the lower-cased text.
LANGUAGE_MARKS = {
    "sv": ("å", "ä", "ö", " och ", " att ", " med ", " för ", " den ", " det ", " är ", " har ", " som ", " till ", " av "),
    "en": (" the ", " and ", " is ", " for ", " with ", " that ", " have ", " from ", " this "),
}

# Patterns of relations in running text, a subject and an object each; case does not matter, \w is any letter, digit or _.
RELATION_PATTERNS = {
    "ceo": (
        r"(\w+(?:\s+\w+)?)\s+är\s+(?:VD|verkställande\s+direktör)\s+(?:för|på|i)\s+(\w+(?:\s+\w+)*)",
        r"VD:?n?\s+(\w+(?:\s+\w+)?)\s+(?:på|för|i)\s+(\w+(?:\s+\w+)*)",
    ),
    "board_chair": (
        r"(\w+(?:\s+\w+)?)\s+är\s+(?:styrelse)?ordförande\s+(?:för|i)\s+(\w+(?:\s+\w+)*)",
        r"ordförande\s+(\w+(?:\s+\w+)?)\s+(?:i|för)\s+(\w+(?:\s+\w+)*)",
    ),
    "owns": (
        r"(\w+(?:\s+\w+)?)\s+äger\s+(\w+(?:\s+\w+)*)",
        r"(\w+(?:\s+\w+)?)\s+har\s+(?:köpt|förvärvat)\s+(\w+(?:\s+\w+)*)",
        r"ägare\s+(\w+(?:\s+\w+)?)\s+(?:till|av)\s+(\w+(?:\s+\w+)*)",
    ),
    "employed_by": (
        r"(\w+(?:\s+\w+)?)\s+arbetar\s+(?:på|för|hos)\s+(\w+(?:\s+\w+)*)",
        r"(\w+(?:\s+\w+)?)\s+är\s+anställd\s+(?:på|hos|vid)\s+(\w+(?:\s+\w+)*)",
    ),
    "associated": (
        r"(\w+(?:\s+\w+)?)\s+(?:och|samt)\s+(\w+(?:\s+\w+)?)\s+samarbetar",
        r"koppling\s+mellan\s+(\w+(?:\s+\w+)?)\s+och\s+(\w+(?:\s+\w+)?)",
        r"(\w+(?:\s+\w+)?)\s+har\s+(?:kontakt|koppling)\s+(?:med|till)\s+(\w+(?:\s+\w+)?)",
    ),
    "transacted_with": (
        r"(\w+(?:\s+\w+)?)\s+(?:betalade|överförde)\s+(?:till|mot)\s+(\w+(?:\s+\w+)?)",
        r"transaktion\s+(?:från|mellan)\s+(\w+(?:\s+\w+)?)\s+(?:till|och)\s+(\w+(?:\s+\w+)?)",
    ),
    "family": (
        r"(\w+(?:\s+\w+)?)\s+är\s+(?:gift|sambo)\s+med\s+(\w+(?:\s+\w+)?)",
        r"(\w+(?:\s+\w+)?)\s+(?:och|samt)\s+(\w+(?:\s+\w+)?)\s+är\s+syskon",
        r"(\w+(?:\s+\w+)?)s?\s+(?:son|dotter|barn|förälder|mor|far)\s+(\w+(?:\s+\w+)?)",
    ),
}

# Role titles and their classes, in the order in which parts are looked for.
ROLES = (
    ("verkställande direktör", "VD"), ("vd", "VD"), ("vice verkställande direktör", "VICE_VD"), ("vice vd", "VICE_VD"),
    ("styrelseordförande", "STYRELSEORDFORANDE"), ("styrelsens ordförande", "STYRELSEORDFORANDE"), ("ordförande", "STYRELSEORDFORANDE"),
    ("styrelseledamot", "STYRELSELEDAMOT"), ("ledamot", "STYRELSELEDAMOT"), ("styrelsesuppleant", "STYRELSESUPPLEANT"), ("suppleant", "STYRELSESUPPLEANT"),
    ("arbetstagarrepresentant", "ARBETSTAGARREPRESENTANT"), ("extern ledamot", "EXTERN_LEDAMOT"), ("auktoriserad revisor", "AUKTORISERAD_REVISOR"),
    ("godkänd revisor", "GODKAND_REVISOR"), ("huvudansvarig revisor", "HUVUDANSVARIG_REVISOR"), ("revisor", "REVISOR"),
)

# Nicknames and the names that they stand for.
NICKNAMES = {"kalle": "karl", "lansen": "lars", "pelle": "per", "nansen": "göran", "benansen": "bengt", "oansen": "ola", "sansen": "sven"}

# Names that serve many companies with good reason, by category in the order of the tests.
EXCLUDED = {
    "audit_firm": (
        "ernst & young", "ey", "öhrlings pricewaterhousecoopers", "pwc", "pricewaterhousecoopers", "kpmg", "deloitte", "grant thornton", "bdo", "rsm",
        "mazars", "forvis mazars", "baker tilly", "azets", "azets revision", "frejs revisorer", "finnhammars", "finnhammars revision", "nexia",
        "moore sweden", "crowe", "pk revision", "revisionsbyrån i", "revisionsbyrå", "revision ab", "revisorer ab", "auktoriserad revisor",
    ),
    "pe_vc": (
        "eqt", "eqt partners", "nordic capital", "investor ab", "patricia industries", "industrivärden", "ratos", "kinnevik", "melker schörling",
        "lundberg", "lundbergföretagen", "wallenberg", "fam ab", "stena", "stena sessan", "varenne", "altor", "triton", "ica gruppen", "creandum",
        "northzone", "atomico", "sequoia heritage", "general atlantic", "balderton", "accel", "insight partners", "verdane", "summa equity", "adelis",
        "axcel", "valedo partners", "holding ab", "invest ab", "förvaltning ab", "investment ab",
    ),
    "law_firm": (
        "freshfields", "linklaters", "clifford chance", "allen & overy", "a&o shearman", "white & case", "baker mckenzie", "dla piper", "dentons",
        "hogan lovells", "latham & watkins", "mannheimer swartling", "vinge", "setterwalls", "roschier", "lindahl", "delphi", "cederquist", "hamilton",
        "hannes snellman", "gernandt & danielsson", "wistrand", "cirio", "advokatbyrå", "advokatfirma", "advokat", "law firm", "attorneys", "juridik ab",
    ),
    "bank": (
        "handelsbanken", "seb", "skandinaviska enskilda banken", "nordea", "swedbank", "danske bank", "dnb", "länsförsäkringar", "hsbc", "barclays",
        "deutsche bank", "bnp paribas", "credit suisse", "ubs", "jp morgan", "goldman sachs", "morgan stanley", "citibank", "carnegie", "pareto",
        "abg sundal collier", "avanza", "nordnet",
    ),
    "corporate_service": (
        "bolagsplatsen", "bolagsverket", "startabolag", "lagerbolag", "bolagsstiftarna", "företagsplatsen", "snabbstart", "lagerbolag ab", "termino",
        "bolagsjuristen", "bolagsservice",
    ),
    "government": (
        "regeringskansliet", "näringsdepartementet", "statens", "riksgälden", "fortifikationsverket", "vattenfall", "postnord", "sj ab", "systembolaget",
        "sveaskog", "akademiska hus", "specialfastigheter", "samhall", "svedab", "kommun", "region", "landsting", "kommunalt",
    ),
}
#: Categories left out of searches for directors of many companies, and for addresses of many companies.
NO_SERIAL_DIRECTOR = ("audit_firm", "pe_vc", "law_firm", "bank", "government")
NO_ADDRESS_CLUSTER = ("corporate_service", "government")

# Playbooks as (steps, types that must not occur, days, severity, typology).
PLAYBOOKS = {
    "invoice_factory": (("formed", "f_skatt_registered", "vat_registered", "address_to_virtual"), ("vat_registered",), 90, "high", "tax_fraud"),
    "phoenix": (("director_removed", "formed", "konkurs"), (), 180, "high", "corporate_fraud"),
    "ownership_layering": (("formed", "foreign_owner_added", "owner_changed", "owner_changed"), (), 365, "medium", "money_laundering"),
    "shelf_company_activation": (("director_removed", "director_added", "address_changed", "sni_changed"), (), 60, "medium", "shell_company"),
    "rapid_asset_stripping": (("owner_changed", "capital_decreased", "debt_registered", "dissolved"), (), 180, "high", "corporate_fraud"),
    "nominee_takeover": (("director_removed", "director_added", "signatory_changed", "address_changed"), (), 30, "high", "shell_company"),
    "pre_bankruptcy_fraud": (("arsredovisning_late", "director_removed", "address_changed", "arsredovisning_missing", "debt_registered"), (), 365, "critical", "corporate_fraud"),
}
