"""Fixed values of the price domain (thresholds and vocabularies)."""

MAX_AGE_DAYS = 14
CENSUS_STALE_DAYS = 3
SIZE_TOLERANCE = 0.06
AUTO_BAND, REVIEW_BAND = 0.62, 0.42
OUTLIER_SHARE, OUTLIER_MIN_PEERS = 0.7, 3
TWO_SHOP_RATIO, MANY_SHOP_RATIO, PER_CATEGORY = 0.5, 0.7, 2
DEAL_MIN_OFFERS, DEAL_MIN_SCORE = 2, 8
STORY_MIN_DAYS, STORY_MIN_POINTS, STORY_LOW_SHARE = 14, 3, 0.02
HISTORY_DAYS = 30
DISAGREEMENT, BASELINE_DAYS = 0.05, 14
SHRINK_BP, UNIT_RISE_BP, SHRINK_CONFIRMATIONS = 300, 200, 2
VAT_STANDARD_BP, VAT_REDUCED_BP, VAT_SLACK_BP = 2100, 1100, 25
DEPOSIT_BANI, DEPOSIT_MIN_L, DEPOSIT_MAX_L = 50, 0.1, 3.0
MAX_STORES = 3
INFERRED_AT = 3
ALERT_DROP, ALERT_HOURS = 0.03, 20
PUSH_DROP_PCT = 10
FANOUT_P95, FANOUT_MAX = 3, 8
MASS_MOVE_SHARE, MASS_MOVE_WRITES, MASS_MOVE_JUMP = 0.05, 200, 0.5
SMEAR_OFFERS, SMEAR_BASES = 5, 2
TIER_MIN_QTY, TIER_MAX_QTY, TIER_MAX_DISCOUNT = 2, 500, 0.60
CONFIRM_LOW, CONFIRM_WEAK, CONFIRM_SAMPLE = 0.15, 0.40, 30
PRICE_CEILING_BANI = {"kg": 50_000 * 100, "l": 100_000 * 100, "buc": 100_000 * 100}
UNIT_FLOOR = 0.05
SILENT_HOURS = 48
SEARCH_MIN_SCORE, SPECIFICITY_WEIGHT, SPECIFICITY_FLOOR = 0.35, 0.5, 3
RARE_MAX, DOMINANCE, BRAND_HEADS = 2, 20, 5
COSINE_MIN = 0.8

# fixed values: words that make another product of a name
VARIANT_MARKERS = [
    "men", "women", "barbati", "femei", "copii", "kids", "baby", "junior",
    "bio", "eco", "organic", "vegan", "light", "zero", "fara", "diet",
    "instant", "macinat", "macinata", "boabe", "feliat", "feliata",
    "afumat", "afumata", "congelat", "congelata",
    "cadou", "set", "caseta", "borseta", "pachet", "multipack",
    "forte", "intense", "extra", "max", "plus", "premium", "sensitive", "clasic", "classic",
]
# fixed values: the same outside groceries only
ALCOHOL_VARIANT_MARKERS = [
    "brut", "rose", "sec", "demisec", "dulce", "demidulce", "spumant", "alb", "rosu", "negru", "neon", "magnum",
]

# fixed values: stop words of match decisions, and unit letters that say nothing
MATCH_STOP = ["de", "cu", "la", "si", "din", "fara", "pentru", "sau", "un", "cel"]
UNIT_NOISE = ["l", "g", "kg", "ml", "cl", "x", "buc", "gr", "bax"]

# fixed values: words that never make a matching anchor
STOPWORDS = ["de", "cu", "la", "si", "din", "fara", "pentru", "sau", "un", "o", "cel", "the", "and", "for"]
# fixed values: words of a brand column that name no brand
NOT_BRANDS = ["non", "brand", "nobrand", "no", "diverse", "altele", "generic", "x", "y", "n", "a", "produs", "marca", "propriu", "fara"]
# fixed values: words by class; two names that each state a value of a class and share none are different products
VARIANT_CLASSES = {
    "flavour": [
        "zmeura", "zmeure", "capsuni", "capsuna", "lamaie", "portocale", "portocala", "cola",
        "vanilie", "cirese", "cireasa", "visine", "visina", "piersici", "piersica",
        "mango", "ananas", "pepene", "tropical", "afine", "afina", "mure", "mura", "kiwi",
        "banane", "banana", "ciocolata", "caramel", "menta", "cocos", "alune", "aluna",
        "fistic", "mar", "mere", "para", "pere", "struguri", "strugure", "grepfrut", "rodie", "lime",
    ],
    "qualifier": ["zero", "light", "max", "twist", "dietetic", "clasic", "classic", "intens", "extra", "forte", "plus", "original", "premium"],
    "fat": [
        "degresat", "degresata", "integral", "integrala", "semidegresat", "semidegresata",
        "slab", "gras", "grasime", "0.1", "1.5", "1.8", "2.5", "3.2", "3.5", "3.8",
    ],
    "format": ["doza", "doze", "pet", "sticla", "sticle", "carton", "cutie", "cutii", "bidon", "galeata", "punga", "plic", "tetra"],
}
# fixed values: what may follow "fara" (without) as one qualifier
WITHOUT = ["zahar", "gluten", "lactoza", "alcool", "cofeina"]
# fixed values: forms of one flavour, the first standing for both
FLAVOUR_FORMS = [
    ["portocale", "portocala"], ["capsuni", "capsuna"], ["cirese", "cireasa"], ["visine", "visina"], ["piersici", "piersica"],
    ["mere", "mar"], ["pere", "para"], ["banane", "banana"], ["afine", "afina"], ["mure", "mura"], ["struguri", "strugure"],
    ["alune", "aluna"], ["zmeura", "zmeure"],
]
# fixed values: describing words by dimension; those without one are noise
DESCRIPTORS = {
    "treatment": ["uht", "pasteurizat", "pasteurizata", "sterilizat", "sterilizata", "proaspat", "proaspata", "refrigerat", "refrigerata"],
    "fat-level": ["integral", "integrala", "degresat", "degresata", "semidegresat", "semidegresata"],
    "packaging": ["pet", "cutie", "sticla", "punga", "caserola", "borcan", "doza", "bidon", "brick", "tetra"],
    "": ["grasime", "consum", "ambalat", "ambalata", "vidat", "vidata"],
}
