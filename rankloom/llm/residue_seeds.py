"""Texts from which the models of template residue, filler, error pages and script notices start. Plain fixed values.

{a|b|c} stands for one of the variants; in TEMPLATE, FIELD stands for one of the fields of `fields`.
"""

from __future__ import annotations

import itertools
import re

#: Names of fields and the ways in which template languages write them.
NAMES = "name first_name last_name user.name username title date city link url email company product summary topic body post.title reply_body clinic_name order_id address phone subject message author n_days dose next_visit user_id"
MARKS = "{{%s}} {{_%s_}} {%s} ${%s} [[%s]] <%=_%s_%> @@%s@@ *|%s|* __%s__ %%s% {{#if_%s}} {{/%s}} {%_%s_%} [%s] <%s> [YOUR_%s] [insert_%s_here] [your_%s] <insert_%s> {{_%s_|_default_}} {{{%s}}} <%s_goes_here> [%s_here] [%s_goes_here] <your_%s> #{%s} [%%s%] $%s$ ${user.%s} {{post.%s}}"

TEMPLATE = """
hi FIELD, welcome back.
hello FIELD,
dear FIELD, your request of FIELD has arrived.
thanks FIELD!
as FIELD said above, start small.
posted on FIELD by FIELD.
see FIELD for details.
the file is at FIELD.
you can find more at FIELD.
visit FIELD to learn more about FIELD.
see FIELD for more.
your FIELD is ready, FIELD.
FIELD said it best.
thank you FIELD for your reply.
written by FIELD on FIELD.
read more about FIELD at FIELD.
your order FIELD has been shipped to FIELD.
FIELD FIELD
best regards, FIELD
click FIELD to unsubscribe from FIELD.
hallo FIELD, willkommen zurück.
bonjour FIELD,
hola FIELD,
"""

#: Text that fills a place instead of content.
FILLER = """
lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo. nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.
vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae; fusce dapibus, tellus ac cursus commodo, tortor mauris condimentum nibh, ut fermentum massa justo sit amet risus. pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
text text text text text text. text goes here. your text here. text here text here. sample text. dummy text. placeholder text. placeholder. this is placeholder text. replace it with your own content. this is a sample answer, replace it. add your content here. insert content here. content goes here. content coming soon. description goes here. enter your answer here. type your answer here. write your reply here.
todo: write the answer. todo: add content. tbd. tk tk tk. to be filled in. fill in later. fixme: write this section. answer to be added. [content missing]. coming soon. under construction.
asdf asdf asdf jkl asdf jkl; asdfghjkl qwerty qwertyuiop zxcvbnm qwer asdf yxcv asdfasdf lkjlkj sdfsdf fghfgh dfgdfg hjkhjk
blah blah blah blah blah. blah blah. bla bla bla bla. foo bar baz foo bar baz qux. test test test test. this is a test. testing 123. hello world hello world. abc abc abc. la la la la. word word word word word. name name name.
xxxxxxx xxxx xxxxxx xx xxxxx xxxxxxxx. xxx xxx xxx. ------- ----- ---- -------. ..... ..... ....... _______ _____ ______. 000000 0000 00000. aaaa aaa aaaaa aaaa. zzzz zzzz.
hier steht ein beispieltext. blindtext blindtext. dies ist ein blindtext. hier text einfügen. platzhalter. mustertext. texte de remplissage. votre texte ici. ceci est un texte factice. texto de ejemplo. texto de relleno. escriba su respuesta aquí. aquí va el texto.
"""

#: What sites and programs say when something failed. Usual messages, from general knowledge.
ERROR = """
error {400|401|403|404|405|408|409|410|429|500|501|502|503|504}
{400 bad request|401 unauthorized|403 forbidden|404 not found|405 method not allowed|408 request timeout|410 gone|429 too many requests|500 internal server error|502 bad gateway|503 service unavailable|504 gateway timeout}
http error {404|500|503}
http {404|408|500|503}: the {page|resource|service|server|gateway} {could not be found|has moved|is not available|timed out|did not respond}.
status={404|500|503} message="the {page|resource|document} {is blocked|is temporarily unavailable|could not be loaded}"
<h1>{404|410|429|500|503}</h1><p>the {page|document|server|file} {could not be loaded|is being updated|is unavailable|was not found}.</p>
an {unexpected|internal|unknown} error {occurred|has occurred} {while loading this page|while processing your request|while saving|during the request} (code {12|500|1020}).
{oops|sorry}, something went wrong. {try again later|reload the page|refresh and try again}.
something went wrong on our end.
the page {you requested|you are looking for} {cannot be found|does not exist|has been removed}.
this {page|content|site|item} is {not available|temporarily unavailable|currently down for maintenance}.
{service|site} {temporarily unavailable|under maintenance}, come back soon.
we are having trouble {loading this page|connecting to the server}. retry.
if {this|the error|the problem} {persists|continues}, contact {support|the administrator|the webmaster}.
{back to home page|return to homepage|retry|go back|reload}
{access denied|permission denied|connection timed out|request timed out|connection refused|connection reset by peer|network error|bad gateway|session expired}
you do not have permission to access this resource. reference #18.2f
{failed to load|could not load|unable to load|unable to connect to} {the comments|resource|database|server}.
your session {expired|timed out}, log in again.
rate limit exceeded. too many requests, try again in 60 seconds.
traceback (most recent call last):\\n  file "{app.py|main.py|views.py|/usr/lib/python3/site.py}", line {12|204|7}, in {main|run|<module>|get}\\n    {return handler(request)|value = data['id']|result = run()}\\n{keyerror: 'id'|valueerror: invalid literal|typeerror: 'nonetype' object is not subscriptable|attributeerror: no attribute 'get'|indexerror: list index out of range|filenotfounderror: no such file}
exception in thread "main" java.lang.{nullpointerexception|illegalstateexception}\\n at com.app.main(main.java:15)
{uncaught typeerror: cannot read properties of undefined|undefined is not a function|nullreferenceexception: object reference not set|segmentation fault (core dumped)}
{fatal error|warning|notice}: {uncaught exception|undefined index: id|mysql_connect(): access denied} in /var/www/html/{index.php|view.php} on line {12|204}
{cannot establish a database connection|database error: deadlock found|sqlstate[hy000] [2002] connection refused|could not connect to the database}
{ "error": { "code": 500, "message": "internal error" } }
{"status": "error", "message": "not found"}
[object object]
error: {failed to fetch|request failed with status code 404|timeout of 5000ms exceeded|could not parse response}
checking your browser before accessing {example.com|the site|this website}. this process is automatic. your browser will redirect to your requested content shortly. please allow up to 5 seconds.
checking {if the site connection is secure|that you are human}. ray id: 7a1b. performance & security by cloudflare.
this site can't be reached. the server took too long to respond. err_connection_{timed_out|refused|reset}
{err_name_not_resolved|err_connection_timed_out|err_empty_response|err_too_many_redirects|err_ssl_protocol_error}
this page isn't working. {the server|example.com} {didn't send any data|redirected you too many times|is currently unable to handle this request}.
upstream {connect error or disconnect/reset before headers|request timeout|server returned an invalid response}. 
the {proxy|upstream|origin} {server|service} {received|returned} an {invalid|empty} response.
the requested url was not found on this server. additionally, a 404 not found error was encountered.
sorry, this content isn't available right now. your request has been blocked.
we're sorry, but something went wrong. if you are the application owner check the logs for more information.
{fehler 403|fehler 404|fehler 500}: {zugriff verweigert|seite nicht gefunden|interner serverfehler|inhalt nicht geladen}
es ist ein {unerwarteter fehler|fehler} aufgetreten. bitte {versuchen sie es später erneut|laden sie die seite neu}.
{die seite|der inhalt} {wurde nicht gefunden|ist nicht verfügbar}. zur startseite
{erreur 404|erreur 500|erreur 503}: {page introuvable|impossible de charger la page|erreur interne du serveur}
une erreur {inattendue est survenue|s'est produite}. {retour à l'accueil|réessayer plus tard|veuillez réessayer}
{la page|le service} {est introuvable|est temporairement indisponible}.
{error 400|error 404|error 503}: {no se pudo cargar la página|página no encontrada|error interno del servidor}
{se ha producido un error|ha ocurrido un error inesperado}. {inténtelo de nuevo más tarde|vuelva a intentarlo}. volver al inicio
{la página|el servicio} {no está disponible|no existe}.
"""

#: Notices that scripts must be enabled. Usual notices, from general knowledge.
SCRIPT = """
{please|you must|you need to|kindly} {enable|activate|turn on|allow} {javascript|scripts|script execution|client-side scripting|java script|js} {to use this page|to continue|to see the content|in your browser|to proceed|before you can read this}.
javascript is {disabled|turned off|not enabled|blocked}. {turn it on and reload the page|enable it and try again}.
this {site|page|app|forum} {requires|needs} {javascript|scripts|client-side scripting} {to work|to function properly|to be displayed}.
we need {scripts|script execution|javascript} {to verify you are human|to show the content|to go on}.
your {browser|settings} {block|blocks|does not support} {scripts|javascript|script execution|client-side scripting}.
{enable|allow} {javascript and cookies|scripts} {and reload|to go on}.
{we've detected|we have detected|it looks like|it seems} that {scripts are off|javascript is disabled|your browser blocks scripts}.
{you must|please} {allow|enable|activate} {javascript|js and cookies|scripts} {and reload the page|in your settings|to display the page}.
you need to enable javascript to run this app.
please enable javascript to view {the comments powered by disqus|this page|this content|the site}.
enable javascript and cookies to continue. please turn javascript on and reload the page.
<noscript>{please enable javascript|scripts are required here|this page needs javascript}.</noscript>
without {javascript|scripts} this {page|form|site} cannot be displayed.
{this page|the content} {cannot be shown|could not be rendered} without {javascript|scripts}.
{scripting|javascript} must be {enabled|active} {to load the page|here}.
bitte {aktivieren sie javascript|schalten sie javascript ein}, um {den inhalt zu sehen|fortzufahren|diese seite anzuzeigen}.
{diese seite benötigt javascript|javascript ist in ihrem browser deaktiviert|skripte müssen aktiviert sein}.
{veuillez activer javascript|activez javascript} pour {voir le contenu|afficher cette page|continuer}.
{javascript est désactivé dans votre navigateur|cette page nécessite javascript}.
{activa javascript|active javascript|habilite javascript} para {ver el contenido|ver la página|continuar}.
{javascript está desactivado en su navegador|esta página requiere javascript}.
"""

#: People who talk about such things, and other texts that only look alike; all other prose comes from the data.
PROSE = """
my head {stops with an error|shows a blue screen} when {money is the topic|i open the mail}.
their {portal|site} gave me a {404|503|timeout} and i {phoned instead|gave up}.
{the clinic site|their page} showed an error {all morning|again}, so i phoned.
i repair {502|500} errors for a living and sleep badly.
i keep getting an error when i log in, has anyone else seen that?
the app says something went wrong every time i try to book, so annoying.
error messages make me panic, i just close the tab.
with javascript switched off, news sites are calmer and i scroll less.
the portal wanted me to enable scripts, so i went there in person.
i learned javascript last year and wrote a little timer script.
my doctor's portal needs javascript and my old laptop hates it.
i block scripts with an add-on, fewer pop ups.
by friday my notes look like lorem ipsum.
my essay was basically lorem ipsum until midnight.
in my sheet the fields are called {task} and {minutes}, simple enough.
i put [name] and [date] in my letter template and fill them in by hand.
i write ${amount} in my budget script and it works.
my template for emails starts with dear {name}, feel free to copy it.
i am 80% done and 20% asleep. it is 50% luck and 100% work.
blah, what a day. testing a new planner this week.
todo lists never work for me, i forget to look at them.
i wrote todo on a sticky note and lost it.
page not found is how my memory works.
switch it off and on again, works for my evenings too.
the moderators took this post down, as it breaks **rule 2**.
this comment was removed by the moderators. please read the rules before posting again.
[the leaflet](https://leaflet.example/start) has pictures.
https://notes.example/meds/120
[deleted] [removed]
i am a bot, and this action was performed automatically. please contact the moderators.
same here. thanks a lot. following this. me too. good luck to you. what helps you most?
talk to your doctor first. tell us how it went. small steps. it took me a month.
i set a timer for ten minutes and then i stop. on bad days one list is enough. i forgot the dentist again and cried a bit.
mir hilft abends ein fester plan. heute war ein guter tag. wie geht ihr damit um? ich bin müde, aber zufrieden. am wochenende haben wir eingekauft und gekocht. meine mutter ruft jeden sonntag an. das wetter ist besser geworden.
wenn ich nicht schlafe, vergesse ich alles. der arzt hat mir etwas anderes verschrieben. nach der arbeit gehe ich eine runde um den see. vielen dank an alle hier. ich weiß nicht, ob das richtig war. es ging dann doch ganz gut.
le soir je fais une liste, et le matin je la perds. merci à tous. comment faites-vous ? il fait beau et nous sortons avec les enfants. ma voisine m'a prêté un livre. le médecin m'a dit d'attendre un peu.
je ne sais pas si c'est normal, mais je dors mieux. après le travail je suis trop fatiguée pour cuisiner. on verra bien la semaine prochaine. c'était plus simple avant. j'ai enfin rangé mon bureau.
por la noche hago una lista y por la mañana la pierdo. gracias a todos. ¿qué os ayuda? mi madre llama todos los domingos. ayer fuimos al mercado y luego a casa. el médico me cambió las pastillas.
no sé si es normal, pero duermo mejor. después del trabajo estoy demasiado cansada para cocinar. ya veremos la semana que viene. antes era más fácil. por fin he ordenado el escritorio.
we went shopping and cooked on the weekend. the weather is better now. the doctor gave me something else and i sleep more. after work i walk around the lake. i do not know if that was right, but it went well in the end.
the old road goes past the mill and up to the village where my grandparents used to live. it was late, so we asked at a farm and stayed there until the morning.
she closed the window, put the letter on the table and thought about what her brother had said. it was not the money; it was that he never asked how anybody else was doing.
on the train home a man told me how he had lost his job and found a better one. he said that waiting was the worst of it, because every day looked the same.
when the children were small we had a garden with apple trees. in autumn the whole street came to help, and we made juice for everybody who had carried a basket.
the teacher said my son is bright but restless, and that he should sit near the door. i was the same at his age and nobody understood why.
it took a long time until i could talk about it. now i write a few lines each evening, and sometimes i read them again and see that things have moved on.
there were more people at the meeting than chairs. they spoke about the new bus line, the noise at night and who should keep the key to the hall.
he bought bread, cheese and two tickets, and on the way he lost one of them. we laughed so much that the woman next to us began to laugh too.
mein kopf meldet einen fehler, sobald jemand steuern sagt.
j'ai eu une erreur 404 sur le site, alors j'ai téléphoné.
me salió un error en la web y llamé por teléfono.
"""


def expand(text: str) -> list[str]:
    """The lines with every slot filled; slots of one line step at different paces, so that many variants arise. Only
    slots with a bar are slots, so that braces may stand in a text."""
    out = []
    for line in text.strip().split("\n"):
        line = line.replace("\\n", "\n")
        parts = re.split(r"\{([^{}]*\|[^{}]*)\}", line)
        slots = [p.split("|") for p in parts[1::2]]
        for n in range(max([len(s) for s in slots], default=1) * (2 if len(slots) > 1 else 1)):
            fill = [s[(n * (k + 1) + n // len(s)) % len(s)] for k, s in enumerate(slots)]
            out.append("".join(itertools.chain.from_iterable(itertools.zip_longest(parts[0::2], fill, fillvalue=""))))
    return out


def fields() -> list[str]:
    """Every name in every mark, in lower and upper case."""
    out = []
    for mark in MARKS.split(" "):
        mark = mark.replace("_", " ") if "__" not in mark else mark
        for n in NAMES.split(" "):
            for name in (n, n.upper()):
                at = mark.rfind("%s") if "%%s" in mark else mark.find("%s")
                out.append(mark[:at] + name + mark[at + 2 :])
    return out + [f"{{{n}}}" for n in range(12)] + ["%s", "%d", "{}", "%1$s", "{{}}", "$1"]
