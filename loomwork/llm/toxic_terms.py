"""A short list of words to start from when abusive language is learnt from a corpus.

SEEDS are insults, obscenities and words that deny people their humanity; an ending in * may be up to three letters
more. PAIRS are two words in a row. CUES are words of reports on such language and of rules about it: a sentence with one
of them is no evidence.
"""

SEEDS = """
idiot* moron* imbecil* asshole* arsehole* bastards bitch* whore* slut* fuck* motherfuck* shit* cunt* dickhead* scum scumbag* vermin subhuman* porn* faggot*
vollidiot* arschloch* arschlöcher wichser* hurensohn* schlampe* fotze* missgeburt* scheiß* scheiss* abschaum ungeziefer
connard* salope* putain* pute enculé* merde* abruti* vermine* bâtard*
imbécil* gilipollas cabrón* puta putas mierda* pendejo* escoria
stronz* coglion* puttan* merda* cazzo vaffanculo feccia bastardi
idiota* cabrão* vadia* caralho foder* escória
klootzak* hoer hoeren kut* eikel* uitschot ongedierte mongool*
""".split()

PAIRS = [("kill", "yourself"), ("hang", "yourself"), ("drop", "dead"), ("geh", "sterben"), ("crève", "donc"), ("muérete", "ya")]

CUES = """
word words term terms rule rules list listed warning moderator moderators removed forbidden banned prohibited reported complaint lexicon
wort wörter regel regeln verboten warnung entfernt moderatoren
mot mots règle règles interdit interdits avertissement modérateur
palabra palabras regla reglas prohibido prohibidas advertencia moderador
parola parole regola regole vietato vietate avviso moderatore
palavra palavras regra regras proibido proibidas aviso
woord woorden regels waarschuwing verwijderd
""".split()
