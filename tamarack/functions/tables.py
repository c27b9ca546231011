"""Tables that must be as they are for right results."""

# --- folding --------------------------------------------------------------------------------------------------

#: Cyrillic and Greek letters that look like Latin ones.
CONFUSABLES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ӏ": "l",
    "А": "A", "В": "B", "Е": "E", "Н": "H", "К": "K", "М": "M", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}

#: Combining marks that are dropped, and invisible characters.
MARKS = "\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
INVISIBLE = "\u200b-\u200f\u2028-\u202f\u2060-\u2069\ufeff\u00ad\u034f\u17b4\u17b5\u180e\ufff0-\uffff"

#: White space as segments and gaps have it.
BLANK = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

#: Characters of words.
WORD = "a-zA-Z0-9\u00c0-\u024f\u0900-\u097f\u0600-\u06ff\u4e00-\u9fff\u3400-\u4dbf"
LATIN = "a-zA-Z\u00c0-\u024f"
APOSTROPHES = "'\u2018\u2019"

# --- decoding -------------------------------------------------------------------------------------------------

#: Sequences that stand for a letter; longer ones go first, then in this order.
SEQUENCES = {
    "\\/\\/": "w", "|\\\\|": "n", "/\\/\\": "n", "/-\\": "a", "|-|": "h", "|_|": "u", "|\\|": "n", "/\\/": "n", "><": "x", "}{": "x", "/\\": "a", "\\/": "v",
    "|)": "d", "|<": "k", "|3": "b", "|*": "p", "|o": "p", "|2": "r", "|=": "f", "|_": "l", "_|": "j", "/<": "k", "/2": "r", "()": "o", "[]": "d", "[)": "d",
    "0_": "q", "`/": "y", "~/": "z", "13": "b", "ph": "f", "vv": "w", "//": "n",
}

#: Single characters that stand for letters.
SINGLES = {
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "§": "s", "!": "i", "|": "i", "+": "t", "†": "t", "(": "c", "<": "c", "{": "c", "[": "c", "^": "a", "#": "h", "*": "", "×": "x",
    "¡": "i", "€": "e", "£": "l", "¥": "y",
    "ä": "a", "á": "a", "à": "a", "â": "a", "ã": "a", "å": "a", "ë": "e", "é": "e", "è": "e", "ê": "e", "ï": "i", "í": "i", "ì": "i", "î": "i",
    "ö": "o", "ó": "o", "ò": "o", "ô": "o", "õ": "o", "ø": "o", "ü": "u", "ú": "u", "ù": "u", "û": "u", "ñ": "n", "ç": "c", "ð": "d",
    "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th",
}

#: Separators that are dropped between two word characters, and punctuation stripped at a segment's edges.
SEPARATORS = ".-_*~`'\"/\\[](){}|"
EDGES = "([{<>)]}'\"`‘’“”«»‹›,.;:?#"

# --- codes ----------------------------------------------------------------------------------------------------

#: Postcodes and flight numbers, on the lower-cased core.
UK_AREAS = (
    "ab|al|b|ba|bb|bd|bh|bl|bn|br|bs|bt|ca|cb|cf|ch|cm|co|cr|ct|cv|cw|da|dd|de|dg|dh|dl|dn|dt|dy|e|ec|eh|en|ex|fk|fy|g|gl|gu|gy|ha|hd|hg|hp|hr|hs|hu|hx|"
    "ig|im|ip|iv|je|ka|kt|kw|ky|l|la|ld|le|ll|ln|ls|lu|m|me|mk|ml|n|ne|ng|nn|np|nr|nw|ol|ox|pa|pe|ph|pl|po|pr|rg|rh|rm|s|sa|se|sg|sk|sl|sm|sn|so|sp|sr|ss|"
    "st|sw|sy|ta|td|tf|tn|tq|tr|ts|tw|ub|w|wa|wc|wd|wf|wn|wr|ws|wv|yo|ze"
)
UK_SUBDISTRICTS = "ec[1-4][amnprvy]|wc1[abehnrvx]|wc2[abehnr]|w1[abcdfghjkstuw]|sw1[aehpvwxy]|se1p|e1w|n1[cp]|nw1w"
CODE_FORMATS = (
    f"^(?:(?:{UK_AREAS})[1-9][0-9]?|{UK_SUBDISTRICTS})[0-9][abdefghjlnpqrstuwxyz]{{2}}$",
    "^[abceghjklmnprstvxy][0-9][abceghjklmnprstvwxyz][0-9][abceghjklmnprstvwxyz][0-9]$",
    "^(?:[a-z]{2}|[a-z][0-9]|[0-9][a-z])[0-9]{3,4}$",
)

# --- contractions ---------------------------------------------------------------------------------------------

#: How contractions are spelled out.
SUFFIXES = {"ll": "will", "re": "are", "ve": "have", "d": "would"}
IS_AFTER = ("he", "she", "it", "that", "what", "who", "there", "here", "where", "how")
NOT_AFTER = {"won": "will", "can": "can", "ain": "is", "shan": "shall"}
ONE_WORD = {
    "im": "i am", "youll": "you will", "youre": "you are", "youve": "you have", "theyll": "they will", "theyre": "they are", "dont": "do not", "didnt": "did not",
    "doesnt": "does not", "isnt": "is not", "arent": "are not", "wasnt": "was not", "werent": "were not", "wont": "will not", "cant": "can not", "aint": "is not",
    "shouldnt": "should not", "wouldnt": "would not", "couldnt": "could not", "gonna": "going to", "wanna": "want to", "gotta": "got to",
    "imma": "i am going to", "u": "you", "ya": "you", "r": "are",
}

# --- Hindi ----------------------------------------------------------------------------------------------------

#: Phonetic folds, applied one after the other.
PHONETIC = (("bh", "b"), ("dh", "d"), ("gh", "g"), ("kh", "k"), ("ph", "f"), ("th", "t"), ("sh", "s"), ("chh", "ch"), ("aa", "a"), ("ee", "i"), ("oo", "u"), ("ai", "e"), ("au", "o"))

#: Devanagari letters in Latin. NUKTA forms are read as one letter, composed or not.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "sh", "ष": "sh",
    "स": "s", "ह": "h", "ळ": "l",
}
NUKTA = {"क": "q", "ख": "kh", "ग": "gh", "ज": "z", "फ": "f", "ड": "r", "ढ": "rh"}
COMPOSED = {"\u0929": "n", "\u0931": "r", "\u0934": "l", "\u0958": "q", "\u0959": "kh", "\u095a": "gh", "\u095b": "z", "\u095c": "r", "\u095d": "rh", "\u095e": "f", "\u095f": "y"}
FLAPS = {"\u0921": "d", "\u0922": "dh", "\u095c": "d", "\u095d": "dh"}  # the other reading of the two flaps
VOWELS = {"अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऋ": "ri", "ऑ": "o"}
MATRAS = {"ा": "aa", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ृ": "ri", "ॉ": "o", "ॅ": "e"}
CODAS = {"ं": "n", "ँ": "n", "ः": "h"}
VIRAMA, NUKTA_MARK, CHANDRABINDU = "्", "़", "ँ"
