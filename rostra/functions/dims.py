"""Dictionaries of the directory domain. Order matters where an earlier entry wins."""

# The record's fields in output order, and their printed headers.
FIELDS = ["region", "ville", "type_centre", "responsable_centre", "specialite", "specialite_detail", "secteur", "titre", "nom", "prenom", "hopital", "adresse", "telephone", "email", "notes", "source", "date_import"]
HEADERS = ["Region", "Ville", "Type de centre", "Responsable du centre", "Specialite", "Detail specialite", "Secteur", "Titre", "Nom", "Prenom", "Hopital", "Adresse", "Telephone", "Email", "Notes", "Source", "Date import"]

# City to administrative region.
REGIONS = {
    "paris": "Ile-de-France",
    "paris robert debre": "Ile-de-France",
    "bobigny": "Ile-de-France",
    "marseille": "Provence-Alpes-Cote d'Azur",
    "nice": "Provence-Alpes-Cote d'Azur",
    "toulouse": "Occitanie",
    "montpellier": "Occitanie",
    "bordeaux": "Nouvelle-Aquitaine",
    "limoges": "Nouvelle-Aquitaine",
    "tours": "Centre-Val de Loire",
    "saint-etienne": "Auvergne-Rhone-Alpes",
    "annecy": "Auvergne-Rhone-Alpes",
    "reims": "Grand Est",
    "nancy": "Grand Est",
    "nantes": "Pays de la Loire",
    "angers": "Pays de la Loire",
    "rouen": "Normandie",
    "brest": "Bretagne",
    "dijon": "Bourgogne-Franche-Comte",
    "la reunion": "La Reunion",
    "lyon": "Auvergne-Rhone-Alpes",
    "strasbourg": "Grand Est",
    "lille": "Hauts-de-France",
    "grenoble": "Auvergne-Rhone-Alpes",
    "clermont-ferrand": "Auvergne-Rhone-Alpes",
}

# Spellings of section headings and of free labels, and prefixes tried in order.
HEADING_SPECIALTIES = {
    "NEPHROLOGUES": "NEPHROLOGIE",
    "NEPHROLOGIE": "NEPHROLOGIE",
    "PNEUMOLOGUES": "PNEUMOLOGIE",
    "PNEUMOLOGIE": "PNEUMOLOGIE",
    "PSYCHIATRES": "PSYCHIATRIE",
    "PSYCHIATRIE": "PSYCHIATRIE",
    "GENETICIENS": "GENETIQUE",
    "GENETIQUE": "GENETIQUE",
    "OPHTALMOLOGUES": "OPHTALMOLOGIE",
    "OPHTALMOLOGIE": "OPHTALMOLOGIE",
    "CARDIOLOGUES": "CARDIOLOGIE",
    "CARDIOLOLOGUES": "CARDIOLOGIE",
    "CARDIOLOGIE": "CARDIOLOGIE",
    "DERMATOLOGUES": "DERMATOLOGIE",
    "DERMATOLOGIE": "DERMATOLOGIE",
    "NEUROLOGUES": "NEUROLOGIE",
    "NEUROLOGIE": "NEUROLOGIE",
    "UROLOGUES": "UROLOGIE",
    "UROLOGIE": "UROLOGIE",
    "AUTRES SPECIALITES": "AUTRE",
}
SPECIALTIES = {k.lower(): v for k, v in HEADING_SPECIALTIES.items()} | {"rhumatologues": "RHUMATOLOGIE", "rhumatologie": "RHUMATOLOGIE"}
SPECIALTY_PREFIXES = {
    "nephro": "NEPHROLOGIE",
    "pneumo": "PNEUMOLOGIE",
    "psychiatr": "PSYCHIATRIE",
    "genet": "GENETIQUE",
    "ophtalmo": "OPHTALMOLOGIE",
    "cardio": "CARDIOLOGIE",
    "dermato": "DERMATOLOGIE",
    "neuro": "NEUROLOGIE",
    "urolog": "UROLOGIE",
    "rhumato": "RHUMATOLOGIE",
}
PHONETIC_SPECIALTIES = list(SPECIALTY_PREFIXES.values())
SPECIALTY_ORDER = ["NEPHROLOGIE", "PNEUMOLOGIE", "PSYCHIATRIE", "GENETIQUE", "OPHTALMOLOGIE", "DERMATOLOGIE", "CARDIOLOGIE", "NEUROLOGIE", "UROLOGIE", "AUTRE"]

# Column header synonyms (field, pattern, is a regex on the raw text).
HEADER_SYNONYMS = [
    ("nom", r"NOM\s*[–\-]\s*PRENOM", True),
    ("nom", "nom", False),
    ("nom", "medecin", False),
    ("nom", "praticien", False),
    ("nom", "referent", False),
    ("prenom", "prenom", False),
    ("hopital", r"H[oô]pital\s+de\s+rattachement", True),
    ("hopital", "hopital", False),
    ("hopital", "etablissement", False),
    ("hopital", "centre hospitalier", False),
    ("hopital", "service", False),
    ("adresse", "adresse postale", False),
    ("adresse", "adresse", False),
    ("telephone", r"T[ée]l[ée]phone", True),
    ("telephone", "tel.", False),
    ("telephone", "tel", False),
    ("telephone", "telephone", False),
    ("email", "adresse mail", False),
    ("email", "adresse email", False),
    ("email", "e-mail", False),
    ("email", "email", False),
    ("email", "mail", False),
    ("email", "courriel", False),
    ("specialite", "specialite", False),
    ("specialite", "discipline", False),
    ("secteur", "secteur", False),
    ("ville", "ville", False),
    ("ville", "site", False),
]

# City spellings, and section headers of word-processor files in the order they are tried.
CITY_SPELLINGS = {"PARIS ROBERT DEBRE": "Paris Robert Debre", "PARIS ROBERT DEBRÉ": "Paris Robert Debre", "SAINT ETIENNE": "Saint-Etienne", "SAINT-ETIENNE": "Saint-Etienne"}
SECTION_CITIES = {
    "Centre Hospitalier Annecy Genevois": "Annecy",
    "CHU de Nantes": "Nantes",
    "CHU de Montpellier": "Montpellier",
    "CHU de Toulouse": "Toulouse",
    "CHU de Marseille": "Marseille",
    "Hôpital Saint-Louis": "Paris",
    "CHU d’Angers": "Angers",
    "CHU d'Angers": "Angers",
    "CHU de Bordeaux": "Bordeaux",
    "CHU de Nice (Hôpital Archet 2)": "Nice",
    "CHU de Nice": "Nice",
    "CHRU de Nancy": "Nancy",
    "CHU de Rouen": "Rouen",
    "CHU de la Réunion": "La Reunion",
    "CHU de Dijon": "Dijon",
    "Hôpital Avicenne, Bobigny": "Bobigny",
    "Hôpital Avicenne": "Bobigny",
    "CHU Brest": "Brest",
}

#: Common French first names, all of the reference's lexicon. Another lexicon is a parameter of the functions that use it.
FIRST_NAMES = """adrien agathe alain alban albane alexandra alexandre alexis alice aline alix amandine ambre amelie anais andre andrea
angele angelique anna anne annick annie anthony antoine antoinette antonin apolline aramis ariane arnaud arthur auguste augustin aurelie
aurelien aurore axel axelle baptiste barbara bastien beatrice benjamin benoit bernadette bernard bertrand blanche boris brice brigitte bruno
camille capucine carine carla carole caroline catherine cecile cedric celeste celia celine chantal charles charlie charline charlotte chloe
christelle christian christiane christine christophe claire claude claudine clelia clement clementine clotilde colette colin come constance
constant corentin corinne cyril cyrille damien daniel daniele danielle david delphine denis denise diane didier dimitri dominique dorothee
edgard edith edmond edouard elena eleonore eliane elie eliott elisa elisabeth elise ellen elodie eloi eloise elsa emile emilie emilien emma
emmanuel emmanuelle enora eric erika ernest esteban estelle esther etienne eugene eugenie eva evan eve evelyne fabien fabienne fabrice fanny
felicie felix ferdinand fernand fernande fiona flavie flavien fleur flore florence florent florentin florian florine francis francois
francoise frederic frederique gabriel gabrielle gael gaelle gaetan garance gaspard gaston gautier genevieve geoffrey geoffroy georges gerald
geraldine gerard germaine ghislaine gilbert gilberte gilles ginette giovanni gisele gregoire gregory guillaume guillemette guy guylaine
gwenaelle hadrien hanna harold helene henri henriette herve hippolyte honore hortense hugo hugues ianis igor ines ingrid irene iris isaac
isabelle isaure ismail jacinthe jack jacob jacqueline jacques jade james jason jean jeanne jeannette jeannine jennifer jeremie jeremy jerome
jessica joachim jocelyn jocelyne joel joelle johan johanne john joseph josephine josette josiane josua judith julia julie julien juliette
justine karine karl katell katia kevin killian laeticia laetitia laurane laure laurence laurent laurie lea leandre leila leo leon leonard
leonie leopold leslie lia liam lili lilian liliane lilou linda lisa lise lisette livia loic lola lorenzo lorraine louis louisa louise louna
lubin luc luca lucas lucie lucien lucienne ludivine ludovic luna lydia lydie mael maelle magali magdalena maia maitena manon marc marceau
marcel marceline marcelle margaux margot marguerite maria mariam marianne marie mariette marilyn marin marina marine marion marius marjorie
martial martine marvin mary maryline maryse mathias mathieu mathilde mathis mathurin mathys matteo mattheo maud maude maurice maxence maxime
maximilien melanie melina meline melissa melodie michael michel michele micheline michelle miguel mila milan milo mireille mohamed monique
morgan morgane muriel myriam nadege nadia nadine nancy naomi nathalie nathan nathaniel nelly nestor nicolas nicole nils noa noah noe noelie
noelle noemie nolan norbert norma norman octave odette odile olga olivia olivier ombeline ophelie oscar oswald owen pablo paola pascal
pascale patrice patricia patrick paul paule paulette pauline perrine peter philemon philippe philippine pierre pierrette pierrick prune
quentin rachel raoul raphael raphaelle raymond raymonde rebecca regine remi remy renaud rene renee rita robert roberte robin roch rodolphe
rodrigue roger roland romain romane romeo rosalie rose roseline sabine sabrina salome samira samuel sandra sandrine sarah sasha sebastien
segolene serge severine side sidonie silvain silvie simon simone solange solene soline sonia sophie stephane stephanie steven suzanne suzie
sybille sylvain sylvette sylvie tanguy tania tatiana thais thao thea theo theodore theophane theophile therese thibault thibaut thierry
thomas tiago timothe timothee titouan tom tony tristan ugo ulysse valentin valentine valeria valerie valery vanessa vera veronique victoire
victor victoria viktor vincent violette virginie vivien vladimir walid wendy william xavier yanis yann yannick yasmine yolande yves yvette
yvon yvonne zelie zoe""".split()
