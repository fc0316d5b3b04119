"""Plain fixed values for finding personal information."""

#: Common given names of several languages.
GIVEN = frozenset(
    "aaron abdul adam adrian ahmed aisha alan albert alejandro alex alexander ali alice amanda amara amina amy ana andrea andreas andrew angela anita anna anne antonio arjun arthur ben benjamin bernd brian bruno carla carlos carmen carol caroline catherine charles charlotte chen chiara chloe christian christine claire clara claudia "
    "daniel david deborah diana diego dieter dimitri dmitri dorothy edward elena elias elizabeth ella emily emma eric erik ernst eva fatima felix fernando florian francesca francois frank gabriel georg george giulia grace greta guillaume hannah hans harry hassan helen helga henrik henry ibrahim ines ingrid irene isabel ivan jack jacob james jan jane javier jean jennifer jens jessica jing joanna joao john jonas jorge jose joseph juan julia julie "
    "karen karl katharina kenji kevin kofi kwame lars laura leila lena leon linda lisa louis louise luca lucia luis lukas mai maja manuel marco marcus margaret maria marie mario mark markus marta martin mary matthew mehmet mei michael miguel mohammed monica nadia natalia nicolas nina noah nora oliver olga omar oscar owen pablo patricia paul paula pedro peter philip pierre priya rachel rafael rebecca richard rita robert rosa ruth samir samuel "
    "sandra sara sarah simon sofia sophie stefan stephen susan sven thomas tim tom tomas ursula vera victor victoria wei william yasmin yuki yusuf zoe".split()
)
#: Titles before a family name.
TITLES = "mr mrs ms miss mx dr doctor prof professor sir dame nurse herr frau hr fr monsieur madame mme mlle señor señora señorita sr sra srta don doña".split()
#: Frequent words that are no family names.
COMMON = frozenset(
    "a about after again ago all also always am an and another any anyone are around as ask asked asks at away back bad be because been before being best better bit both but by call called came can cannot club come could day days dear did do does doing done down each either else even ever every everyone far fc few find first for found friend friends from gave get gets give go goes going gone good got great group had has have he hello help helped helps her here hers hey hi him his home honestly how i if in into is it its just keep kept "
    "know last late later left let like list little long look lot love made make makes many may maybe me meant meeting meets met might mine more most much must my name need needs never new next no not nothing now of off oh ok old on once one only or other our ours out over own people please put rather read really regards right runs said same saw say says school see seen send sent she should since sir so some someone something soon spent still street such take takes team tells than thank thanks that the their them then there these they thing "
    "think this those though thought time to today told too took tried try turns two under until up us use used uses very want wants was wasn watch way we week well went were what when where which while who whole why will with without won work works worth would write wrote year years yes yesterday yet you your yours yourself "
    "und oder aber der die das ist war hat habe ich du er sie es wir ihr mein meine mit von für auf im am et ou mais le la les est était il elle nous vous mon ma avec pour dans sur y o pero el los las es era yo mi su con por para en que "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december english german french spanish".split()
)
#: What stands after a title in figures of speech.
FIGURATIVE = frozenset("internet google web wikipedia youtube reddit tiktok facebook chatgpt bing search ai bot brain adhd perfect right wrong nobody nice grumpy happy lazy smart clever know-it-all procrastination chaos time nature strange who house evil bean t robot potato money fix-it anxiety executive moderator mod admin president minister chairman speaker".split())
#: Street words after a name, before one, and at the end of one.
STREET_AFTER = "street str st road rd lane ln avenue ave av drive dr way close court ct crescent cres row place pl square sq terrace boulevard blvd gardens gdns hill grove mews parade walk rise parkway highway hwy alley view"
STREET_BEFORE = "rue avenue boulevard chemin impasse allée quai place calle avenida avda paseo plaza carrer via viale piazza"
STREET_END = "straße strasse str. weg platz allee gasse ring damm ufer chaussee steig pfad"
#: Named houses.
HOUSES = "house cottage farm farmhouse lodge villa manor hall grange barn mill rectory vicarage"
#: Works and games whose number and name look like an address.
WORKS = "track level novel book chapter song album stage episode season game map round movie film scene part volume issue stuck page hole mission quest"

#: Words that announce a number of a person at an authority, insurer, tax office or clinic.
ID_WORDS = (
    r"ssn|social security(?: (?:number|no\.?|card))?|national insurance(?: (?:number|no\.?))?|ni number|nino|nhs(?: (?:number|no\.?))?|health(?:care)?(?: record| card| insurance)? (?:number|no\.?|id)|health record|mrn|medical record(?: (?:number|no\.?))?|"
    r"patient(?: (?:number|no\.?|id|file))|chart number|case number|passport(?: (?:number|no\.?))?|driv(?:er|ing)(?:['’]?s)? licen[cs]e(?: (?:number|no\.?))?|licen[cs]e number|insurance (?:id|number|no\.?|policy)|policy (?:number|no\.?)|member(?:ship)? (?:id|number|no\.?)|medicare(?: number)?|medicaid(?: number)?|"
    r"tax(?:payer)? (?:ref(?:erence)?|id|number|no\.?|file number)|tin|itin|utr|sin|tfn|id(?:entity)? card(?: (?:number|no\.?))?|id number|identity number|identification number|national id|personal id|"
    r"steuer-?(?:id|nummer|identifikationsnummer)|sozialversicherungsnummer|versicherten(?:nummer|-?nr\.?)|krankenkassen(?:nummer|-?nr\.?)|versicherungsnummer|personalausweis(?:nummer)?|ausweis(?:nummer)?|reisepass(?:nummer)?|patientennummer|führerschein(?:nummer)?|"
    r"numéro (?:de sécurité sociale|fiscal|de passeport|de patient|d['’]assuré)|sécurité sociale|carte d['’]identité|carte vitale|nir|insee|passeport|permis de conduire|"
    r"dni|nie|nif|número de (?:la )?seguridad social|seguridad social|pasaporte|carn[eé]t de conducir|número de (?:paciente|afiliado)|tarjeta sanitaria|cédula|curp|cpf|bsn|pesel|codice fiscale"
)
#: Words that announce a number of something else.
OTHER_WORDS = (
    r"order|ticket|isbn|issn|serial|version|tracking|parcel|invoice|receipt|booking|reservation|flight|model|part|item|sku|code|score|row|seat|studies|study|doi|pmid|error|build|commit|job|batch|lot|course|price|cost|costs|percentile|level|track|case of|bestellnummer|rechnung|seriennummer|commande|facture|pedido|factura"
)
#: Words that announce a telephone number.
PHONE_WORDS = (
    r"call|phone|ring|text|tel|telephone|mobile|cell|whatsapp|signal|fax|dial|sms|number is|line|reach me|contact|telefon|handy|nummer ist|ruf|anrufen|téléphone|appelle|appelez|portable|numéro|teléfono|llama|llámame|móvil|número es"
)
#: Number words by digit.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Words of offices and their papers, near which a number is rather one of a person.
OFFICE_WORDS = (
    r"form|forms|clinic|hospital|surgery|office|insurer|insurance|authority|file|files|record|records|reference|system|letter|card|badge|identity|identification|patient|claim|benefits?|"
    r"formular|klinik|praxis|amt|behörde|kasse|krankenkasse|akte|ausweis|formulaire|dossier|caisse|mutuelle|hôpital|préfecture|formulario|clínica|hospital|seguro|expediente|oficina"
)
#: Whose.
POSSESSIVES = r"my|his|her|our|their|your|mein|meine|meinem|meiner|unser|unsere|mon|ma|notre|mi|nuestro|nuestra"
#: People in relation to somebody.
RELATIONS = (
    r"doctor|psychiatrist|psychologist|therapist|gp|dentist|nurse|pharmacist|coach|teacher|tutor|professor|boss|manager|supervisor|colleague|coworker|landlord|neighbor|neighbour|friend|roommate|flatmate|sister|brother|mother|father|mum|mom|dad|son|daughter|wife|husband|partner|boyfriend|girlfriend|ex|cousin|aunt|uncle|grandmother|grandfather|"
    r"arzt|ärztin|psychiater|psychiaterin|therapeut|therapeutin|chef|chefin|lehrer|lehrerin|nachbar|nachbarin|freund|freundin|schwester|bruder|mutter|vater|frau|mann|kollege|kollegin|"
    r"médecin|psychiatre|psychologue|thérapeute|patron|collègue|ami|amie|soeur|sœur|frère|mère|père|femme|mari|voisin|voisine|"
    r"médico|médica|psiquiatra|psicólogo|psicóloga|terapeuta|jefe|jefa|profesor|profesora|amigo|amiga|hermana|hermano|madre|padre|mujer|marido|esposo|esposa|vecino|vecina"
)
#: What people do after their name.
ACTS = (
    r"said|says|told|asked|wrote|called|replied|answered|thinks|thought|suggested|suggests|explained|recommended|prescribed|diagnosed|referred|promised|insisted|laughed|smiled|emailed|phoned|texted|"
    r"sagte|sagt|fragte|schrieb|meinte|erklärte|rief|disait|dit|demande|écrit|répond|propose|dijo|dice|preguntó|escribió|llamó|recetó|contestó"
)
