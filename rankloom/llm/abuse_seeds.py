"""Word classes and labelled sentences from which the abuse tagger starts; ratings of the data are added to them.

Everything here is a plain fixed value. In the sentences {a|b|c} stands for one of the variants.
"""

from __future__ import annotations

import itertools
import re

#: Words of each class, in English, German, French and Spanish.
CLASSES = {
    "you": "you your yours u ur yourself yourselves you're youre ya op du dich dir dein deine euch ihr tu toi te vous votre ta ton tes tú tí ti vosotros usted",
    "me": "i me my mine myself im i'm ich mich mir mein meine je j moi mon ma mi mí yo",
    "insult": "idiot idiots moron morons imbecile loser losers clown clowns coward cowards rat rats pig pigs cow bitch bitches bastard bastards asshole assholes arsehole dumbass jerk cunt cunts dickhead prick wanker twat freak freaks goblin troll failure excuse trash garbage scum parasite parasites vermin cockroach cockroaches retard retards psycho whiner dimwit halfwit cretin degenerate degenerates piece waste thief lowlife wretch crybaby "
    "dummkopf vollidiot arschloch wichser schlampe versager abschaum hurensohn missgeburt fotze depp trottel feigling drecksau connard connasse salope pute crétin débile abruti ordure enculé imbécile lâche raclure merdeux ratée raté "
    "idiota imbécil gilipollas cabrón puta zorra escoria basura estúpido estúpida cobarde inútil mierda payaso payasa asqueroso desgraciado",
    "slur": "subhuman subhumans animals beasts plague filth disease dogs apes savages infestation rubbish inferior untermenschen ungeziefer viehzeug sous-hommes vermine infrahumanos ratas plaga alimañas parásitos",
    "mean": "stupid pathetic worthless disgusting useless filthy dumb lazy hopeless spineless brain-dead braindead sad ugly fat miserable vile rotten dirty weak crazy insane mental retarded medicated dumm blöd hässlich widerlich wertlos erbärmlich dreckig moche laid stupide nul nulle dégoûtant pathétique feo fea gordo patético asqueroso tonto tonta",
    "harm": "kill smash strangle punch hit slap beat break stab shoot hang rot die dies burn rape choke hurt suffer drown crush bleed destroy gut lynch sterilise sterilize deport exterminate gas cull bash pain dead jaw teeth face cancer bus "
    "umbringen töten verrecken verrecke sterben stirb schlagen aufhängen vergasen erschießen prügeln zähne fresse tuer crever crève mourir frapper casser dents gueule pendre égorger matar morir muérete romper cara golpear ahorcar dientes reventar",
    "sexual": "nude nudes naked cock dick dicks pussy tits boobs porn horny slut sluts whore panties moan cum cumming strip lick suck blowjob fucked orgasm sexy uncensored onlyfans erotic escort hookup thrust nipples ass erection wet tight lonely gorgeous "
    "nackt nackte titten ficken geil schwanz muschi blasen nacktbilder nue nues bite chatte baiser sucer seins cul coquine sexe desnuda desnudo follar follarte polla tetas coño chupar guapa caliente",
    "swear": "fuck fucking fucked shit shitty damn crap bloody hell goddamn wtf gtfo stfu piss arse bullshit scheiße scheiß verdammt verpiss merde putain bordel joder coño hostia",
    "report": "called calls said yelled told shouted wrote screamed heard stings asked once jokes joke quote quoted someone",
    "group": "foreigners immigrants migrants refugees women females autistics neurodivergents gays lesbians trans jews muslims christians blacks whites disabled poor folk kind lot people gypsies tribe ausländer flüchtlinge frauen behinderte étrangers immigrés femmes handicapés extranjeros inmigrantes mujeres gente pobres",
    "wish": "hope hopes wish deserve deserves should ought pity imagine hoffe verdienst wünsche espère souhaite mérites ojalá espero mereces",
    "out": "shut off gtfo disappear breed breeding breathe breathing oxygen exist vanish hau verschwinde verpiss dégage casse disparais lárgate vete cállate calla",
}
HARSH = {"insult", "slur", "mean", "harm", "sexual", "swear"}

#: Sentences that are abusive, hateful or sexual as a whole. Written from general knowledge of such language,
#: not from any table; what the data's own abuse is like, the ratings tell.
TOXIC = """
{you are|you're} {an idiot|a moron|a loser|such a coward|a piece of garbage}
what {an idiot|an asshole|an imbecile|a loser} you are
you {stupid cow|filthy rat|useless imbecile|spineless clown}
you {disgusting|pathetic|stupid|worthless} {pig|bitch|bastard|failure}
shut up, {idiot|moron|you bitch}
shut your mouth, {moron|bitch|loser}
hey {loser|moron|idiot}, {go away|nobody asked you|get out of here}
nobody likes you, {asshole|freak|you piece of trash}
everybody hates you, {freak|loser}
nobody would cry for {you|a rat like you}
fuck off, {asshole|bastard|you idiot}
fuck you, {op|idiot|you useless prick}
go fuck yourself
get lost, you {retard|psycho}
{stfu|gtfo} you {whining loser|attention whore}
you make me sick
you were born {stupid|a mistake}
you are {dumb as a rock|utterly worthless|brain-dead}
how {dumb|pathetic|worthless} are you, {op|loser}
your whole family is {trash|scum|a joke}
you should be ashamed, {pig|you failure}
your {kids|children|parents} must {hate|pity} {you|such a failure}
{cry more|keep crying}, {baby|loser|snowflake}
only {an idiot|a coward} {says|believes|writes} {this|such garbage}
the author is {a moron|an idiot|a pathetic clown}
kill yourself, {loser|you worthless pig}
just kill yourself already
go {die|hang yourself|jump off a bridge}, {loser|coward}
drop dead, {idiot|bitch}
{rot|burn} in hell, {bastard|scum}
i hope you {die|rot|choke|suffer}
i hope your {family|house} {dies|burns}
you deserve {pain|to suffer|to die}
i will {kill you|beat you up|cut your throat|hurt you}
i am going to {break your legs|punch your face|burn your house}
i know where you live
you will {regret this|bleed for this}, {bitch|coward}
wait until i {get you|catch you}, {bitch|rat}
watch your back, {coward|rat}
somebody {should|ought to} {slap|punch|hit} you
a good {slap|beating} would fix you
all {women|immigrants|muslims|jews|gays|blacks|refugees} are {stupid|vermin|criminals|animals|disgusting}
{refugees|gypsies|immigrants} are a {plague|disease}
{women|blacks|jews} are inferior
i hate {gays|muslims|foreigners}, they are {filth|sick|scum}
get those {dirty|filthy} {foreigners|refugees} out
{hang|gas|deport} {them all|the lot of them|every foreigner}
{disabled people|autistics} are a {burden|waste|mistake}
send those {animals|savages|parasites} back
{lock up|get rid of} {those freaks|these people}
stop breeding, {parasite|vermin}
your kind {is vermin|should not exist|disgusts me}
send {nudes|me nude pictures|me a naked photo}
show me your {boobs|ass|pussy|tits}
i want to {fuck you|suck your dick|lick you|have you naked}
i am so horny {now|for you}, {dm me|text me}
my cock is {hard for you|bigger than yours}, baby
your {ass|body|lips} {makes|make} me hard
bend over and {take it|spread your legs}
wanna {fuck|sext|see me naked}?
sexy girls want to fuck, click here
watch my {porn|naked videos|webcam} for free
buy my {nudes|sex tape|worn panties}, dm me
{lonely|horny} and {naked|wet}, write me
she {moaned|begged} while he {fucked her|licked her}
du bist {ein idiot|ein erbärmlicher versager|abschaum|ein stück scheiße}
halt die fresse, du {arschloch|idiot|vollidiot}
verpiss dich, du {hurensohn|wichser|schlampe}
geh sterben, du {versager|abschaum}
bring dich doch um
ich hoffe du {verreckst|stirbst}
ich {schlage dich|mach dich fertig|bringe dich um}
{ausländer|flüchtlinge|frauen} sind {abschaum|ungeziefer|dreck}
schick mir {nacktbilder|nacktfotos}
ich will dich {ficken|nackt sehen}
tu es {un idiot|une ordure|un pauvre raté}
ferme ta gueule, {connard|salope}
va {crever|te faire foutre}, {connard|ordure}
je vais te {frapper|tuer|casser la gueule}
j'espère que tu vas {crever|souffrir}
les {étrangers|femmes|immigrés} sont {de la vermine|des parasites}
dégage, {abruti|crétin}
envoie tes photos nue
je veux te {baiser|voir nue}
eres {un idiota|una basura|un inútil}
cállate, {idiota|imbécil|zorra}
vete a la mierda, {cabrón|gilipollas}
ojalá te mueras, {idiota|basura}
te voy a {matar|pegar|reventar}
los {extranjeros|inmigrantes} son {escoria|ratas}
manda fotos desnuda
quiero {follarte|verte desnuda}
"""

#: Sentences that are none of these, though they hold words of the classes; likewise of general knowledge.
CLEAN = """
i live at {12 mill lane|the old house, 4 rose court|calle mayor 8, 2 b}, come by
new address: {51 willow way|7b station road, northfield|box 1204, hill town}
text {555 0100|zero seven seven|me at +44 20 7946} tomorrow
call me on {555 0199|my mobile} after six, evenings only
credit to u/quiet_{leaf|river}12 for the idea
ask for {doctor brown|mary hill|mr stone} at the desk
best, {mary|john carter|ana lopez}
the form has {tax number 123456|my id 99 123|nothing} on it
{mary hill|john carter} runs our local group
ich wohne in der {bergstraße 5|lindenallee 12b}
mi número es {555 0142|secreto}
growing up i thought i was {worthless|lazy|stupid}
i am such an idiot, i forgot {my keys|the bread|the appointment} again
i feel {stupid|worthless|pathetic|useless} when {i lose my keys|the list grows}
my memory is {trash|garbage|useless} today
i am a mess and a lazy cow today, and that is okay
i hate {mornings|this printer|the noise|my alarm} with a passion
i hate {mondays|the dentist|my inbox}
i would kill for {a coffee|a nap}
this {bloody printer|damn form|stupid app} {broke|froze} again
the exam {killed|destroyed} me
{crap|shitty} week, good weekend
holy shit, the timer actually works
fuck, i forgot {my meds|the meeting} again
well shit, the bus is late
fucking finally the pharmacy answered
screw this {form|stupid spreadsheet}
oh hell no, not another meeting
my boss called me {stupid|an idiot|useless} and it hurt
a stranger shouted '{freak|loser|get out}' at me and i cried
my ex said i was a {worthless failure|lazy bitch} and i believed it for years
my dad told me to stop being so {dumb|lazy}
someone told me to kill myself and i reported it
in school they called us {retards|freaks} and nobody stopped them
i was told people like me are {lazy|stupid}
i disagree with you {completely|about this}
your advice did not work for me, sorry
that is a bad idea, you should ask a doctor first
honestly i think you are wrong about the dose
you are not {lazy|stupid|broken}, your brain works differently
you are not a failure, be kind to yourself
you deserve {rest|better|help}
i hope you {feel better|get some rest|find a good doctor}
hope this helps you
please do not call yourself {stupid|lazy|an idiot}
the meds killed my {appetite|sex drive}
the pills lower my sex drive and my doctor knows
my mind wanders during sex
we talked about sex and {side effects|intimacy} with the therapist
is it normal that the drug affects {erections|orgasm|libido}?
condoms and birth control may interact with the tablets, ask your pharmacist
my breast cancer screening is next week
this deadline is {killing|murdering} me
i bombed the interview and want to sink into the ground
my battery died and the plan is dead
kill the notifications first, then breathe
beat the clock, break the task into pieces
hit the gym, smash the list, die on the sofa
my dog is a stupid happy idiot
the cat is a coward and i love it
that movie was garbage
this game is trash, the boss beat me again
shut off the phone, shut the door, start
i put the trash out and washed the dirty dishes
the poor thing slept all day
women are often diagnosed late
many immigrants wait months for a referral
autistics and people with adhd share some traits
the disabled parking is full again
ich bin so ein idiot, ich habe den termin vergessen
ich hasse montage
scheiße, der bus ist weg
mein chef nannte mich faul und dumm, das tut noch weh
je suis nul en rangement et c'est pas grave
je déteste le lundi
merde, j'ai raté le bus
soy un desastre con los papeles
odio los lunes
mierda, se me olvidó la cita
"""


def expand(text: str) -> list[str]:
    """The sentences with every slot filled; slots of one sentence step together, so that variants, not products, arise."""
    out = []
    for line in text.strip().split("\n"):
        parts = re.split(r"\{([^{}]*)\}", line)
        slots = [p.split("|") for p in parts[1::2]]
        for n in range(max([len(s) for s in slots], default=1)):
            fill = [s[n % len(s)] for s in slots]
            out.append("".join(itertools.chain.from_iterable(itertools.zip_longest(parts[0::2], fill, fillvalue=""))))
    return out
