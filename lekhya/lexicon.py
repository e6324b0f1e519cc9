"""Word lists, limits and patterns of transcript analytics.

Fixed values: results agree with existing transcripts only if these do. Pass other tables to
the operators for another language or domain.
"""

from __future__ import annotations

DANDA = "।"

# Number words and what they stand for.
UNITS = {
    "शून्य": 0, "एक": 1, "दो": 2, "तीन": 3, "चार": 4, "पाँच": 5, "छह": 6, "सात": 7, "आठ": 8, "नौ": 9,
    "दस": 10, "ग्यारह": 11, "बारह": 12, "तेरह": 13, "चौदह": 14, "पंद्रह": 15, "सोलह": 16, "सत्रह": 17, "अठारह": 18, "उन्नीस": 19,
    "पांच": 5, "छः": 6,
}
TENS = {
    "बीस": 20, "इक्कीस": 21, "बाईस": 22, "तेईस": 23, "चौबीस": 24, "पच्चीस": 25, "छब्बीस": 26, "सत्ताईस": 27, "अट्ठाईस": 28, "उनतीस": 29,
    "तीस": 30, "इकतीस": 31, "बत्तीस": 32, "तैंतीस": 33, "चौंतीस": 34, "पैंतीस": 35, "छत्तीस": 36, "सैंतीस": 37, "अड़तीस": 38, "उनतालीस": 39,
    "चालीस": 40, "इकतालीस": 41, "बयालीस": 42, "तैंतालीस": 43, "चौवालीस": 44, "पैंतालीस": 45, "छियालीस": 46, "सैंतालीस": 47, "अड़तालीस": 48, "उनचास": 49,
    "पचास": 50, "इक्यावन": 51, "बावन": 52, "तिरपन": 53, "चौवन": 54, "पचपन": 55, "छप्पन": 56, "सत्तावन": 57, "अट्ठावन": 58, "उनसठ": 59,
    "साठ": 60, "इकसठ": 61, "बासठ": 62, "तिरसठ": 63, "चौंसठ": 64, "पैंसठ": 65, "छियासठ": 66, "सड़सठ": 67, "अड़सठ": 68, "उनहत्तर": 69,
    "सत्तर": 70, "इकहत्तर": 71, "बहत्तर": 72, "तिहत्तर": 73, "चौहत्तर": 74, "पचहत्तर": 75, "छिहत्तर": 76, "सतहत्तर": 77, "अठहत्तर": 78, "उनासी": 79,
    "अस्सी": 80, "इक्यासी": 81, "बयासी": 82, "तिरासी": 83, "चौरासी": 84, "पचासी": 85, "छियासी": 86, "सत्तासी": 87, "अट्ठासी": 88, "नवासी": 89,
    "नब्बे": 90, "इक्यानवे": 91, "बानवे": 92, "तिरानवे": 93, "चौरानवे": 94, "पचानवे": 95, "छियानवे": 96, "सत्तानवे": 97, "अट्ठानवे": 98, "निन्यानवे": 99,
}
MULTIPLIERS = {"सौ": 100, "हज़ार": 1000, "हजार": 1000, "लाख": 100_000, "करोड़": 10_000_000, "करोड": 10_000_000}
FRACTIONS = "डेढ़ सवा ढाई अढ़ाई पौने साढ़े साढे".split()
#: Figurative numbers. Boundaries are white space, as combining marks make \b differ between engines.
IDIOMS = [
    r"(?<!\S)(एक|दो|तीन|चार|पाँच|पांच)-(चार|दो|पाँच|छह|सात|आठ|नौ|दस)\s+\S",
    r"(?<!\S)एक[-\s]दो(?!\S)",
    r"(?<!\S)(दो|तीन|चार)[-\s](तीन|चार|पाँच|पांच)(?!\S)",
    r"(?<!\S)एक\s+बार(?!\S)",
    r"(?<!\S)सात\s+समुंदर",
    r"(?<!\S)नौ\s+दो\s+ग्यारह(?!\S)",
    r"(?<!\S)चार\s+चाँद(?!\S)",
    r"(?<!\S)दस[-\s]बीस(?!\S)",
    r"(?<!\S)तीन[-\s]पाँच(?!\S)",
]

NUMBER_EDGES = "।.,!?;:'\""
TAGGER_EDGES = NUMBER_EDGES + "-()[]"
TAIL_MARKS = "।.,!?;:"

SEGMENT_FILLERS = "हाँ हूं जी नहीं अ ह म्म ओह आं हम्म uh um hmm".split()
FUNCTION_WORDS = "है का को में यह वह से की के पर तो भी ने ही तक पे ना हैं था थे थी एक और कि जो इस उस".split()
INSERTED_FILLERS = "uh um hmm हम्म अ आ ऊं ह म्म हाँ ओह अच्छा".split()
CASUAL_MARKERS = "मेको तेको बोहोत बहोत यार मतलब करना करो बताओ देखो सुनो भाई".split()

MIN_SECONDS, MAX_SECONDS, MIN_LETTERS, MIN_WORDS_PER_SECOND, MIN_RMS = 1.0, 30.0, 5, 0.8, 0.002
SAMPLE_RATE = 16_000
CLASSIFY_REPEATS, REPAIR_REPEATS = 8, 5

#: Loanwords of one token; longer entries could never equal a token.
LOANWORDS = """
मोबाइल फ़ोन फोन कंप्यूटर लैपटॉप इंटरनेट वेबसाइट ऐप एप स्क्रीन ऑनलाइन ऑफलाइन वाईफाई ब्लूटूथ डाउनलोड अपलोड चार्जर बैटरी कैमरा वीडियो
स्कूल कॉलेज क्लास क्लासेस एग्जाम एग्जामिनेशन सब्जेक्ट सबजेक्ट प्रोजेक्ट असाइनमेंट होमवर्क एडमिशन फीस सिलेबस टॉपिक टेस्ट स्टूडेंट टीचर प्रिंसिपल प्रोफेसर
जॉब ऑफिस मीटिंग प्रेजेंटेशन रिपोर्ट इंटरव्यू सैलरी मैनेजर टीम क्लाइंट बिज़नेस कंपनी स्टार्टअप सीटीओ सीईओ
बैंक लोन ईएमआई पेमेंट रिफंड डिस्काउंट ऑफर डील बजट इन्वेस्टमेंट शेयर स्टॉक
मूवी फिल्म सीरीज सॉन्ग एल्बम यूट्यूब नेटफ्लिक्स इंस्टाग्राम ट्विटर फेसबुक वॉट्सएप व्हाट्सएप रील पोस्ट स्टोरी लाइव
बस ट्रेन फ्लाइट होटल ट्रिप टूर टैक्सी ऑटो रेस्टोरेंट कैफे पिज़्ज़ा बर्गर जूस फ्रूट्स
नार्मल नॉर्मल एक्चुली बेसिकली लिटरली सीरियसली ऑबवियसली डेफिनेटली परफेक्ट एक्साइटेड एक्साईटेड नर्वस स्ट्रेस रिलैक्स बोर कूल ओके
हैलो हाय बाय थैंक्यू सॉरी प्लीज़ प्लीज बट रेडी सेट डन फाइन नाइस ग्रेट सुपर बेस्ट वर्स्ट स्मार्ट फन फनी
लूडो कैरम क्रिकेट फुटबॉल बास्केटबॉल गेम प्लेयर स्कोर मैच
प्रॉब्लम सॉल्यूशन आइडिया प्लान स्ट्रेटेजी रिसेंटली ऑल्रेडी डायरेक्ट सिम्पल क्लियर पॉइंट वर्जन अपडेट फीचर मोड सेटिंग रेट क्वालिटी डिमांड सप्लाई
परसेंट किलोमीटर किलोग्राम मीटर मिनट स्कूटी बाइक कार प्ले लिस्ट प्लेलिस्ट
""".split()
SUFFIXES = "ाओं ियों ों ें ो ी ा े".split()
NATIVE_ENDINGS = "ना ने नी ता ती ते था थी थे गा गी गे कर के की को में पर वाला वाली वाले कारण तरह".split()
NATIVE_WORDS = """
भी जी नहीं यही वही सही कई और तो जो जब अब कब यहाँ वहाँ कहाँ कभी सभी आगे पीछे ऊपर नीचे लेकिन क्योंकि मगर परंतु यदि तथा
हाँ हां शायद ज़रूर बिल्कुल मेरा तेरा हमारा आपका उनका इनका मुझे तुझे उसे हमें आपको उन्हें इसलिए इसलिये इसीलिए यानी मतलब
बहुत थोड़ा ज़्यादा कम सबसे बेहद पहले बाद अभी हमेशा कभी-कभी क्या कौन कैसे कितना किसका किसे अच्छा बुरा नया पुराना बड़ा छोटा ठीक गलत जरूरी ज़रूरी
""".split()
#: Marks of borrowed words; a match each, two are enough. The last two are one ending that counts twice.
BORROWED_MARKS = ["[टड]्", "ऑ", "फ़", "ज़", "[क-ह]्[क-ह]्[क-ह]", "शन$", "मेंट$", "इंग$", "ली$", "ली$"]

#: Misheard words and what was said.
REPAIR_SEED = {
    "काज़न": "कजन", "बच्छे": "बच्चे", "उवो": "वो", "अतना": "इतना", "पाद्टी": "पार्टी", "अपलोर": "पॉपुलर", "पसिन्देता": "पसंदीदा",
    "मुझेक": "म्यूजिक", "आटेश्ट": "आर्टिस्ट", "तराय": "ट्राई", "थादे": "ढाबे", "जादे": "ज्यादा", "जादा": "ज्यादा", "प्रना": "पुराना",
    "पंकिके": "पंखे", "बेल्टी": "बैठी", "हासी": "हंसी", "मजाग": "मजाक", "गितना": "इतना", "किता": "कहता", "दिडी": "दीदी",
    "गर": "घर", "चुटी": "छुट्टी", "असने": "उसने", "सोड़ा": "सोचा", "नाई": "नए", "पसंट": "पसंद", "बतलब": "मतलब",
    "हैर": "हर", "गंटी": "घंटी", "फुरा": "पूरा", "वबही": "वह", "किना": "नहीं", "अहां": "हम", "चुछा": "चुप",
}

#: Categories in the order in which equal counts are listed.
CATEGORIES = ["repetition_loop", "code_switching", "casual_colloquial", "proper_nouns", "number_quantifier", "deletion_function_words", "insertion_noise", "other"]
TEXT_COLUMNS = ["sentence", "raw_transcription", "transcription", "text"]
