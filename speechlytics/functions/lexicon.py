"""Word tables. All lookups are by exact code points; nukta letters are decomposed (base + U+093C), nothing is normalised."""

from __future__ import annotations

# Number words by value from 0 to 99, variants joined by "/".
NUMBERS = """
शून्य एक दो तीन चार पांच/पाँच छह/छः सात आठ नौ दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस बीस इक्कीस
बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस
उनतालीस चालीस इकतालीस बयालीस तैंतालीस चवालीस पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास पचास इक्यावन बावन तिरपन चौवन
पचपन छप्पन सत्तावन अट्ठावन उनसठ साठ इकसठ बासठ तिरसठ चौंसठ पैंसठ छियासठ सड़सठ अड़सठ उनहत्तर सत्तर इकहत्तर बहत्तर
तिहत्तर चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उनासी अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी अट्ठासी
नवासी नब्बे इक्यानवे बानवे तिरानवे चौरानवे पचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे
"""

# Multipliers.
MULTIPLIERS = {"सौ": 100, "हज़ार": 1000, "हजार": 1000, "लाख": 100000, "लाख़": 100000, "करोड़": 10000000, "करोड": 10000000}

# Idioms around which numbers stay words.
IDIOMS = [
    r"दो-चार\s+\S+",
    r"दो-तीन\s+\S+",
    r"चार-पांच\s+\S+",
    r"एक-दो\s+\S+",
    r"दो-एक\s+\S+",
    r"तीन-चार\s+\S+",
    r"दस-बीस\s+\S+",
    r"सौ-दो\s+सौ",
    r"एकाध\s+\S+",
    r"चारों\s+",
    r"दोनों\s+",
    r"तीनों\s+",
    r"पहला|दूसरा|तीसरा|चौथा",
]

# Loanwords that are tagged.
LOANWORDS = """
ऑनलाइन ऑफलाइन सॉफ्टवेयर हार्डवेयर वेबसाइट ईमेल पासवर्ड डाउनलोड अपलोड अपडेट डिलीट सर्वर डेटा डेटाबेस नेटवर्क वाईफाई
ब्लूटूथ एप्लिकेशन ऐप ब्राउज़र गूगल लैपटॉप टैबलेट सोशल मीडिया डिजिटल टेक्नोलॉजी प्रोग्राम कोड प्रोग्रामिंग एल्गोरिदम
इंजन सिस्टम स्टूडेंट कोर्स सर्टिफिकेट ट्यूशन लाइब्रेरी लेक्चर सेमेस्टर सब्जेक्ट बिजनेस कंपनी ऑफिस मीटिंग मैनेजर बॉस
प्रोजेक्ट रिपोर्ट प्रेजेंटेशन इंटरव्यू जॉब सैलरी प्रमोशन रिज्यूम क्लाइंट कस्टमर मार्केट मार्केटिंग प्रोडक्ट सर्विस
ब्रांड एडवर्टाइजिंग इन्वेस्टमेंट बजट प्रॉफिट लॉस टार्गेट स्ट्रेटेजी पार्टनर डील पेशेंट अपॉइंटमेंट एंटीबायोटिक
इम्यूनिटी थेरेपी फार्मेसी सप्लीमेंट एयरपोर्ट पासपोर्ट विज़ा फ्लाइट पार्किंग हाईवे रूट पिज़्ज़ा बर्गर ज्यूस सॉस सलाद
सैंडविच नूडल्स मैगी टेनिस बैडमिंटन ओलंपिक प्लेयर कोच स्कोर ट्रॉफी चैंपियन स्टेडियम कप्तान मूवी एक्टर डायरेक्टर
प्रोड्यूसर म्यूजिक सॉन्ग वीडियो चैनल शो ड्रामा कॉमेडी सीरीज सीज़न एपिसोड यूट्यूब इंस्टाग्राम फेसबुक ट्विटर पॉलिसी
गवर्नमेंट पार्लियामेंट इलेक्शन लीडर कमिटी मिनिस्टर कमिश्नर रजिस्ट्रेशन फैशन ड्रेस जैकेट शूज डिज़ाइन डिज़ाइनर स्टाइल
कलर टाइम प्रॉब्लम सॉल्यूशन ऑप्शन प्लान लिस्ट ग्रुप मेंबर फॉर्म बुक परसेंट रेट लेवल टॉप बेस्ट फर्स्ट लास्ट नेक्स्ट
फ्री स्पेशल एक्स्ट्रा ओके थैंक्स सॉरी प्लीज हैलो बाय एड्रेस एरिया पॉइंट पर्सनल सीक्रेट सेफ रिस्क चांस सक्सेस फेल पास
फैक्ट ट्रेंड इश्यू टॉपिक इंपॉर्टेंट सीरियस नॉर्मल पॉजिटिव नेगेटिव रियल
"""

# Loanwords that count as Hindi and are never tagged.
ABSORBED = """
डॉक्टर नर्स हॉस्पिटल मेडिसिन ऑपरेशन इंजेक्शन वैक्सीन सर्जरी टेस्ट बस ट्रेन टैक्सी ट्रैफिक पेट्रोल डीज़ल स्टेशन टिकट
ड्राइवर स्कूल कॉलेज यूनिवर्सिटी क्लास टीचर प्रोफेसर एग्जाम रिजल्ट डिग्री फोन मोबाइल कंप्यूटर इंटरनेट टीवी रेडियो
कैमरा पुलिस कोर्ट जज वोट पार्टी चॉकलेट बिस्किट केक कॉफी आइसक्रीम क्रिकेट फुटबॉल हॉकी मैच टीम गोल शर्ट पैंट जींस नंबर
पेपर कॉपी फिल्म बैग होटल रेस्टोरेंट लाइसेंस
"""

# Dictionary words.
FUNCTION_WORDS = """
मैं तू तुम आप वह वे यह ये हम वो इन्हें उन्हें जिन्हें उसका उसकी उसके मेरा मेरी मेरे तेरा तेरी तेरे तुम्हारा तुम्हारी
तुम्हारे हमारा हमारी हमारे उनका उनकी उनके इसका इसकी इसके इनका इनकी इनके कोई कुछ सब अपना अपनी अपने खुद स्वयं जो कौन
क्या किसी में पर को से के का की ने तक द्वारा लिए लिये बाद पहले ऊपर नीचे बीच साथ बिना अंदर बाहर सामने पीछे बारे
अनुसार अलावा बजाय विरुद्ध प्रति दौरान बावजूद और या लेकिन मगर परंतु किंतु परन्तु किन्तु क्योंकि इसलिए जब तब अगर तो कि
ताकि जबकि हालांकि चाहे बल्कि यानी अर्थात यानि एवं तथा अथवा है हैं था थी थे थीं हूँ हूं हो होगा होगी होंगे होंगी होता
होती होते होना हुआ हुई हुए हुईं
"""

# Dictionary words.
ADJECTIVES = """
अच्छा अच्छी अच्छे बुरा बुरी बुरे बड़ा बड़ी बड़े छोटा छोटी छोटे नया नई नए पुराना पुरानी पुराने पूरा पूरी पूरे काला
काली काले सफ़ेद लाल ऊँचा ऊँची ऊँचे लंबा लंबी लंबे गहरा गहरी गहरे मोटा मोटी मोटे पतला पतली पतले गरम ठंडा ठंडी ठंडे
सस्ता सस्ती सस्ते महंगा महंगी महंगे सही गलत ग़लत ज़रूरी ज़्यादा ज्यादा कम काफ़ी काफी बहुत थोड़ा थोड़ी थोड़े सारा
सारी खास अलग पहला दूसरा तीसरा ख़ास ज़रा ज़रूर ज़ोर
"""

# Dictionary words.
NOUNS = """
लोग बात बातें काम दिन रात समय वक़्त वक्त साल महीना हफ़्ता हफ्ता घंटा मिनट तरह तरीका घर दरवाज़ा दरवाजा कमरा रास्ता
जगह शहर गाँव गांव देश दुनिया ज़मीन ज़िंदगी जिंदगी ज़िन्दगी जिन्दगी आसमान पानी हवा आग पेड़ फूल फल पत्ता नदी पहाड़
समुद्र आदमी औरत बच्चा बच्ची बच्चे लड़का लड़की माँ पिता बाप भाई बहन बहिन दोस्त परिवार भगवान ईश्वर धर्म पूजा मंदिर
सरकार नेता मंत्री राजा प्रधानमंत्री पैसा रुपया रुपये खाना दूध चाय रोटी चावल दाल सब्ज़ी सब्जी नमक चीनी कपड़ा कपड़े
किताब क़लम कलम कागज़ कागज गाड़ी सड़क पुल आँख कान नाक मुँह हाथ पैर सिर पेट दिल दिमाग़ दिमाग आवाज़ आवाज ख़बर खबर ख़ुशी
खुशी मुश्किल तस्वीर इतिहास भविष्य वर्तमान
"""

# Dictionary words.
ADVERBS = """
अब तब कब जब यहाँ यहां वहाँ वहां कहाँ कहां जहाँ जहां आज कल परसों अभी हमेशा कभी फिर भी ही तो न ना नहीं मत हाँ हां जी
बस काश शायद ज़रूर ज़रा सच सिर्फ़ सिर्फ केवल बिल्कुल ठीक वैसे ऐसे कैसे ऐसा वैसा कैसा इतना उतना जितना कितना सबसे बहुत
ज़्यादा कम तुरंत जल्दी धीरे अचानक बार
"""

# Dictionary words.
TITLES = """
श्री श्रीमती सुश्री महोदय महोदया जनाब साहब
"""

# Verb roots and the endings that each takes in the dictionary.
VERB_ROOTS = """
कर हो जा आ दे ले कह बोल सुन देख पढ़ लिख खा पी सो रह चल बैठ मिल रख सोच समझ चाह पा लग मान बता जान मार उठ बन बना खेल गा
रो हँस पहुँच निकल पूछ भेज खोल बंद सीख भूल रुक गिर उड़ तोड़ छोड़ पकड़ काट धो चुन बदल डाल निकाल हटा बचा जोड़ सम्भाल
संभाल इस्तेमाल
"""
VERB_ENDINGS = """
ना ता ती ते ा ी े ो ें ूँ ूं ेगा ेगी ेंगे ेंगी ाना ाती ाता ाते ाया ाई ाए ाओ ाये ाइए ाइये
"""

# Suffixes tried in this order by the spelling rules.
SUFFIXES = """
ता ती ते ना नी ने या यी ये ेगा ेगी ेंगे ेंगी ाना ाई ाए ाओ वाला वाली वाले कार दार गार पन पना आई ीय इक ीन आत त्व ित
मान वान ें ों ियाँ ियां ओं ो ी े
"""


def number_words() -> dict[str, int]:
    return {w: n for n, ws in enumerate(NUMBERS.split()) for w in ws.split("/")}


def dictionary() -> list[str]:
    """The built-in dictionary: core words, verb forms by rule, numbers, and all loanwords."""
    forms = [r + e for r in VERB_ROOTS.split() for e in ("", *VERB_ENDINGS.split())]
    core = " ".join((FUNCTION_WORDS, ADJECTIVES, NOUNS, ADVERBS, TITLES, LOANWORDS, ABSORBED)).split()
    numbers = [w for w, n in number_words().items() if n <= 20 and w != "शून्य"]
    return sorted({*core, *forms, *numbers, *(m for m in MULTIPLIERS if m not in ("लाख़", "करोड"))})
