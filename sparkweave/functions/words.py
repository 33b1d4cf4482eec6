"""Word lists and tables that record linkage goes by (fixed values)."""

NAME_SHORT = {"corporation": "corp", "incorporated": "inc", "limited": "ltd", "private": "pvt", "company": "co"}

ADDRESS_SHORT = {
    "road": "rd", "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "lane": "ln", "court": "ct", "apartment": "apt",
    "suite": "ste", "floor": "fl", "building": "bldg", "north": "n", "south": "s", "east": "e", "west": "w",
}

NAME_STOP = (
    "inc corp corporation ltd limited pvt private llc llp co company and the of in for center centre group services solutions "
    "enterprises associates holdings management international global industries systems technologies tech dba"
).split()
NAME_STOP_MORE = "praivet treding".split()

ADDRESS_STOP = (
    "st rd ave blvd dr ln court ct way street road avenue boulevard drive lane apt suite ste fl floor bldg building near opp "
    "opposite behind phase sector plot shop no number us usa india null"
).split()
ADDRESS_STOP_MORE = "ground first second third c/o flats nagar dist district state".split()

TOY_NAME_STOP = "the and inc corp llc ltd co pvt".split()
TOY_ADDRESS_STOP = "st rd ave blvd dr ln apt ste".split()

LEGAL = "inc corp corporation ltd limited pvt llc llp sarl sa gmbh".split()
GENERIC = "enterprises trading services solutions industries holdings group consulting".split()
GENERIC_FP = "enterprises trading industries services solutions".split()
GENERIC_NAMES = "star krishna om shree apex royal elite shri".split()

#: First code points of the nine Brahmic blocks of 128 code points, which follow each other.
INDIC_FIRST, INDIC_LAST, INDIC_BLOCK = 0x0900, 0x0D7F, 0x80
#: Latin sounds by place in a block.
INDIC_LATIN = {
    0x01: "n", 0x02: "m", 0x03: "h",
    0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "r", 0x0C: "l",
    0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au",
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "ch", 0x1B: "chh", 0x1C: "j", 0x1D: "jh", 0x1E: "n",
    0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n",
    0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x34: "l", 0x35: "v",
    0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x3C: "", 0x3D: "",
    0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "r", 0x44: "r", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x4D: "",
    0x55: "", 0x56: "ai", 0x57: "au", 0x58: "q", 0x59: "kh", 0x5A: "gh", 0x5B: "z", 0x5C: "r", 0x5D: "rh", 0x5E: "f", 0x5F: "y",
    0x66: "0", 0x67: "1", 0x68: "2", 0x69: "3", 0x6A: "4", 0x6B: "5", 0x6C: "6", 0x6D: "7", 0x6E: "8", 0x6F: "9",
}
