"""The value lists of the TPC-H tables and the comment words."""

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

NATIONS = [
    ("ALGERIA", 0), ("ARGENTINA", 1), ("BRAZIL", 1), ("CANADA", 1), ("EGYPT", 4),
    ("ETHIOPIA", 0), ("FRANCE", 3), ("GERMANY", 3), ("INDIA", 2), ("INDONESIA", 2),
    ("IRAN", 4), ("IRAQ", 4), ("JAPAN", 2), ("JORDAN", 4), ("KENYA", 0),
    ("MOROCCO", 0), ("MOZAMBIQUE", 0), ("PERU", 1), ("CHINA", 2), ("ROMANIA", 3),
    ("SAUDI ARABIA", 4), ("VIETNAM", 2), ("RUSSIA", 3), ("UNITED KINGDOM", 3),
    ("UNITED STATES", 1),
]

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
INSTRUCTIONS = ["COLLECT COD", "DELIVER IN PERSON", "NONE", "TAKE BACK RETURN"]
MODES = ["AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK"]

TYPE_GRADES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
TYPE_FINISHES = ["ANODIZED", "BRUSHED", "BURNISHED", "PLATED", "POLISHED"]
TYPE_METALS = ["BRASS", "COPPER", "NICKEL", "STEEL", "TIN"]
CONTAINER_SIZES = ["JUMBO", "LG", "MED", "SM", "WRAP"]
CONTAINER_KINDS = ["BAG", "BOX", "CAN", "CASE", "DRUM", "JAR", "PACK", "PKG"]

COLORS = (
    "almond antique aquamarine azure beige bisque black blanched blue blush brown burlywood "
    "burnished chartreuse chiffon chocolate coral cornflower cornsilk cream cyan dark deep dim "
    "dodger drab firebrick floral forest frosted gainsboro ghost goldenrod green grey honeydew "
    "hot indian ivory khaki lace lavender lawn lemon light lime linen magenta maroon medium "
    "metallic midnight mint misty moccasin navajo navy olive orange orchid pale papaya peach "
    "peru pink plum powder puff purple red rose rosy royal saddle salmon sandy seashell sienna "
    "sky slate smoke snow spring steel tan thistle tomato turquoise violet wheat white yellow"
).split()

ADVERBS = ["quietly", "swiftly", "warily", "gently", "slowly", "boldly", "neatly", "keenly"]
SUBJECTS = [
    "parcels", "ledgers", "invoices", "couriers", "harbours", "drafts", "pallets", "brokers",
    "margins", "cargoes", "tallies", "depots", "orchards", "engines", "signals", "vessels",
]
VERBS = [
    "settle", "gather", "depart", "return", "balance", "wander", "expire", "arrive",
    "combine", "dwindle", "persist", "recover", "advance", "recede", "collide", "repeat",
]

# Places in the first phrase where a comment may start.
STARTS = 16

# Every adverb with every subject and every verb.
PHRASES = [f"{a} {s} {v}" for a in ADVERBS for s in SUBJECTS for v in VERBS]
# Longer pieces for long comments: every adverb with every subject and the verb in its
# place, followed by the one 37 places on.
PAIRED = [f"{a} {s} {v}" for a in ADVERBS for s, v in zip(SUBJECTS, VERBS)]
SENTENCES = [f"{p}, {q}" for p, q in zip(PAIRED, PAIRED[37:] + PAIRED[:37])]
