"""Fixed vocabularies of the Hindi transcript operators, as plain text."""

from __future__ import annotations

# The words for 0 to 99, in order; spellings of one number are separated by a slash.
UNIT_WORDS = """
शून्य एक दो तीन चार पाँच/पांच छह/छः सात आठ नौ
दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस
बीस इक्कीस बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस
तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस
चालीस इकतालीस बयालीस तैंतालीस चवालीस पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास
पचास इक्यावन बावन तिरपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ
साठ इकसठ बासठ तिरसठ चौंसठ पैंसठ छियासठ सड़सठ अड़सठ उनहत्तर
सत्तर इकहत्तर बहत्तर तिहत्तर चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उन्यासी
अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी अट्ठासी नवासी
नब्बे इक्यानवे बानवे तिरानवे चौरानवे पचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे
"""
UNITS = {word: n for n, group in enumerate(UNIT_WORDS.split()) for word in group.split("/")}

# Multipliers.
MULTIPLIERS = {
    "सौ": 100,
    "हज़ार": 1000,
    "हजार": 1000,
    "हज़ारों": 1000,
    "लाख": 100000,
    "लाखों": 100000,
    "करोड़": 10000000,
    "करोड़ों": 10000000,
    "अरब": 1000000000,
}

# Idioms that hold number words; a space stands for any white space.
IDIOMS = """
दो-चार
चार-पाँच
दो-तीन
एक-दो
तीन-चार
सात-आठ
दो-एक
एक-आध
चार चाँद
एक नंबर
दो नंबर
तीन तेरह
नौ दो ग्यारह
साठ पाट
छत्तीस का आंकड़ा
एक से एक
""".strip().splitlines()

# English words in Devanagari.
LOANWORDS = """
कंप्यूटर कम्प्यूटर लैपटॉप मोबाइल फोन इंटरनेट वेबसाइट ऐप सॉफ्टवेयर हार्डवेयर
डेस्कटॉप टैब टेबलेट वाईफाई ब्लूटूथ पेनड्राइव माउस कीबोर्ड स्क्रीन डिस्प्ले
प्रोग्राम प्रोग्रामिंग कोड कोडिंग डेटा सर्वर डेटाबेस नेटवर्क ऑनलाइन ऑफलाइन
इंटरव्यू जॉब ऑफिस कंपनी बॉस मीटिंग प्रोजेक्ट टीम मैनेजर रिपोर्ट
सैलरी प्रमोशन रिज्यूमे स्किल ट्रेनिंग वर्कशॉप प्रेजेंटेशन डेडलाइन टास्क शिफ्ट
स्कूल कॉलेज यूनिवर्सिटी क्लास एग्जाम रिजल्ट टेस्ट स्टूडेंट टीचर प्रोफेसर
डिग्री सर्टिफिकेट कोर्स सब्जेक्ट टॉपिक लाइब्रेरी लैब होमवर्क असाइनमेंट नोट्स
पिज्जा बर्गर चॉकलेट कॉफी टी बिस्किट केक आइसक्रीम सैंडविच ब्रेड
सॉस चीज़ क्रीम जूस कोल्डड्रिंक
प्रॉब्लम सॉल्व टाइम टाइमिंग पार्किंग ट्रैफिक रोड फ्लोर लिफ्ट एलिवेटर
शॉप शॉपिंग मार्केट बजट डिस्काउंट ड्राइवर कार बस ट्रेन फ्लाइट
हॉस्पिटल डॉक्टर नर्स मेडिसिन टैबलेट पेशेंट ऑपरेशन चेकअप ट्रीटमेंट
फैशन ब्रांड स्टाइल डिज़ाइन कलर म्यूजिक मूवी फिल्म सीरीज शो
गेम स्पोर्ट्स क्रिकेट फुटबॉल टेनिस ट्रेडिशनल मॉडर्न फैमिली फ्रेंड पार्टी
फेसबुक ट्विटर इंस्टाग्राम यूट्यूब गूगल वीडियो फोटो सेल्फी लाइक शेयर
पोस्ट कमेंट फॉलो ट्रेंडिंग वायरल
बिज़नेस कस्टमर क्लाइंट प्रोडक्ट सर्विस मार्केटिंग इन्वेस्टमेंट प्रॉफिट लॉस फंड
हैप्पी सैड गुड बैड नाइस परफेक्ट इंपॉर्टेंट सिंपल ईज़ी हार्ड
क्लियर कन्फ्यूज़ टेंशन स्ट्रेस रिलैक्स
स्टार्ट स्टॉप चेक ट्राई यूज़ प्रैक्टिस डिस्कस एक्सप्लेन एक्सप्लोर एक्चुअली
बेसिकली डायरेक्ट अप्लाई
पैशन डांसिंग इंफॉर्मेशन फीडबैक हार्ट प्योर बिहेव गिफ्टेड लैंड
हीट वेव्स वेब्स इजी स्ट्रगल
""".split()

# Endings of English words in Devanagari, for tagging (words longer than 3) and spelling (longer than 4).
TAG_SUFFIXES = "शन िंग मेंट नेस टर ली फुल".split()
SPELL_SUFFIXES = "शन मेंट नेस िंग टर ली फुल लेस".split()

# Frequent Hindi words.
COMMON_WORDS = """
है हैं था थी थे हो हुआ हुई
का की के को से में पर ने
और या कि जो तो भी ही सा
यह वह ये वो मैं हम तुम आप
जी नहीं हाँ हां ना मत बस
कर करना करें किया होना जाना आना
अच्छा बहुत कुछ सब कैसे क्या कब
अब तब जब पहले बाद साथ लिए
एक दो तीन चार पांच छह सात आठ
वाला वाली वाले कोई किसी अपना अपनी
""".split()

# Valid Hindi endings.
VALID_SUFFIXES = "ों ें ाँ ाएँ ाओं ियों ाना ाने ता ती ते ना ने नी कर कार वाला वाली वाले पन पना दार हार गार".split()

# Vowel signs and other marks.
MATRAS = "ािीुूृेैोौंँःॅॉ"
PLAIN_MATRAS = "ािीुूृेैोौ"
HALANT = "्"
NUKTA = "़"
NASALS = ["ं", "ँ", "ः"]

# Confusable vowel signs and consonants (from>to), and fillers.
VOWEL_SWAPS = "ा>ो ो>ा ी>ि ि>ी ू>ु ु>ू े>ै ै>े".split()
CONSONANT_SWAPS = "ब>व व>ब ड>ड़ ड़>ड श>ष ष>श न>ण ण>न".split()
FILLERS = "हम्म अ आ उम्म एम".split()

# Error categories (key, name, description, proposed fix, whether it can be acted on).
CATEGORIES = [
    ("vowel_matra_error", "Vowel / Matra Error", "Incorrect vowel marks (matras) - e.g., ा vs ो, ी vs ि",
     "Post-processing substitution map for common matra confusions. Build a confusion matrix from training data and apply rule-based corrections for high-confidence substitutions (e.g., when context disambiguates ा/ो).", True),
    ("consonant_confusion", "Consonant Confusion", "Similar-sounding consonants confused - e.g., ब vs व, ड vs ड़",
     "Add data augmentation with acoustically similar consonant pairs. Use a phoneme-aware language model to rescore n-best hypotheses.", False),
    ("word_boundary_error", "Word Boundary Error", "Words merged or split incorrectly",
     "Post-processing word segmentation using a Hindi dictionary lookup. When two words are merged, try splitting at all valid positions and check if both halves are valid Hindi words.", True),
    ("code_switching_error", "Code-Switching Error (Hindi-English)", "English words in Hindi conversation misrecognized or script-switched",
     "Fine-tune with code-switching augmented data. Add English loan words commonly used in Hindi (interview, computer, phone) to the training vocabulary.", False),
    ("homophone_confusion", "Homophone Confusion", "Words that sound similar but are spelled differently",
     "Context-aware post-processing using a Hindi language model to select the most likely candidate among homophones.", False),
    ("insertion_deletion", "Insertion / Deletion", "Extra words added or words dropped from transcription",
     "Post-processing confidence-based filtering. Remove low-confidence tokens and add commonly missed filler words based on acoustic patterns.", True),
    ("number_transcription", "Number Transcription Error", "Numbers written as digits vs words, or wrong number words",
     "Post-processing number normalization. Apply Hindi number word ↔ digit conversion rules.", True),
    ("punctuation_filler", "Punctuation / Filler Word Error", "Filler words (हम्म, अ) or punctuation differences",
     "Rule-based filler word normalization. Remove common ASR-inserted fillers and standardize punctuation.", True),
    ("visarga_anusvara", "Visarga / Anusvara / Chandrabindu Error", "Nasal marks (ं, ँ) or visarga (ः) errors",
     "Rule-based post-processing to add/remove anusvara (ं) based on Hindi grammar rules (e.g., before प/ब/म consonants, nasal mark is expected).", True),
    ("other", "Other / Unclassified", "Errors not fitting other categories",
     "Investigate further with more data to determine root cause.", False),
]
