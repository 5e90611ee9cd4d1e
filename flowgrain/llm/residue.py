"""Template residue, filler and error-page text (problem 8).

Method: one multi-pattern automaton holds multilingual phrases of error pages, of notices that scripts, cookies or a browser
check are needed, of filler, and of navigation, together with the vocabulary that such notices are made of. Phrases are
written as patterns with alternatives and expanded when the automaton is built. A sentence is residue if it holds a
phrase and its vocabulary covers enough of its content words, or if vocabulary alone covers nearly all of them; function
words, names, paths and numbers count for neither side, and what stands in quotes or code is talked about and counts as
content. A document is excluded when residue covers most of what is left of it without title, navigation and markup.
Placeholders count by themselves wherever they stand, but not in code, charts or back quotes, and not in a sentence that
talks about notation.

Defined results: null, empty and blank texts are no cases; texts of any length are read whole; repeated rows are
judged alike and all come out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from flowgrain.functions.labels import CHART_HEADER
from flowgrain.session import widen

#: Residue needed, as a share of the text without title, navigation and markup.
COVERED = 0.6
#: Share of a sentence's content words that the vocabulary of notices must cover beside a phrase, and without one.
WITH_PHRASE, ALONE = 0.5, 0.8

# Phrases in lower case, several with `;` or one a line; (a|b) is one of several. By language: English, German,
# French, Spanish, Italian, Portuguese, Dutch, Polish, Swedish, Turkish, Czech, Russian, Chinese, Japanese, Korean.
ERROR = """(400|401|403|404|405|408|410|429|500|501|502|503|504)( -|:| –|) (bad request|unauthorized|unauthorised|forbidden|not found|method not allowed|request timeout|gone|too many requests|internal server error|internal|not implemented|bad gateway|service unavailable|gateway timeout|gateway time-out)
(bad request|bad gateway|gateway timeout|gateway time-out|internal server error|internal error|server error|application error|fatal error|service unavailable|temporarily unavailable|temporarily offline|too many requests|method not allowed|request timeout|request timed out|connection timed out|connection refused|connection reset|connection failed|database error|network error|proxy error|unexpected error|unknown error|access denied|access is denied|permission denied|permission required|not authorised|not authorized|unauthorized access|under maintenance|down for maintenance|due to maintenance|scheduled maintenance|no longer available|no longer exists|does not exist|doesn't exist|try again later|something went wrong|oops!|page not found|file not found|no such page|could not be loaded|could not be found|cannot be found|can't be found|cannot be displayed|cannot be reached|can't be reached|most recent call last|unhandled exception|uncaught exception|stack trace:)
(error|http|http error|status|error code|code) (40|41|42|50|51)
(page|site|document|file|resource|url|link|address|content|server|website|article|item) (was not found|not found|could not be found|cannot be found|can't be found|could not be loaded|cannot be displayed|could not be displayed|cannot be reached|can't be reached|is unavailable|is not available|is currently unavailable|has been removed|has been moved|may have been removed|has expired|took too long|may be broken)
(requested|the requested|you requested|you are looking for|you were looking for|are trying to reach|are trying to access) (page|url|resource|document|file|content|article)
(an error|an unexpected error|an internal error|a problem|a fatal error) (has occurred|occurred|was encountered|happened)
(can't find what you|cannot find what you|could not find what you|what you are looking for|page you requested|contact the administrator|e-mail the administrator|contact the webmaster|contact support|if the problem persists|if this error persists|our team has been|has been notified|has been told|reference number|incident number|please slow down|please try again|back in a few minutes|will be back soon|we'll be back|be right back|session expired|session has expired|your session|please sign in again|please log in again|need to be signed in|need to be logged in|need to be a member|you need to be|must be logged in|do not have permission|don't have permission|no permission to|not allowed to view|not permitted to|took too long to answer|took too long to respond|refused to connect|closed the connection|upstream closed|check your connection|check the address|check the url|cannot include|failed to load|failed to open|could not open|could not be processed|error processing|on line|no route matches|reported a bad gateway|encountered an error|having technical difficulties|technical difficulties)
(seite|datei|dokument|angeforderte seite|adresse|ressource) (nicht gefunden|wurde nicht gefunden|konnte nicht gefunden|existiert nicht|ist nicht verfügbar|nicht erreichbar|gibt es nicht mehr|konnte nicht geladen)
(die angeforderte seite|zugriff verweigert|zugang verweigert|keine berechtigung|nicht berechtigt|ein fehler ist aufgetreten|interner fehler|interner serverfehler|fehler 404|fehler 50|fehler beim laden|nicht gefunden|gibt es nicht mehr|sitzung abgelaufen|ihre sitzung|melden sie sich|später noch einmal|später erneut|laden sie die seite|wartungsarbeiten|wegen wartung|nicht verfügbar|zeitüberschreitung|verbindung fehlgeschlagen|dienst nicht verfügbar|bitte versuchen sie es)
(page|la page|page demandée|le document|le fichier) (introuvable|est introuvable|n'existe pas|n'existe plus|non trouvée|est indisponible|n'a pas été trouvée|n'a pas pu être)
(la page demandée|accès refusé|accès interdit|accès non autorisé|erreur interne|erreur 404|erreur 50|erreur du serveur|une erreur est survenue|une erreur s'est produite|session expirée|connectez-vous|réessayez plus tard|veuillez réessayer|service indisponible|en maintenance|délai dépassé|est introuvable)
(página|la página|el documento|el archivo|el recurso) (no encontrada|no encontrado|no existe|no se encontró|no se ha encontrado|no está disponible|no disponible|ya no existe)
(acceso denegado|acceso prohibido|error interno|error del servidor|se ha producido un error|ha ocurrido un error|sesión caducada|la sesión ha|vuelva a entrar|inicie sesión|inténtelo de nuevo|inténtelo más tarde|vuelva a intentarlo|servicio no disponible|en mantenimiento|no encontrada|no tiene permiso)
(pagina|la pagina|il documento|il file) (non trovata|non trovato|non esiste|non è disponibile|non disponibile|non è stata trovata)
(accesso negato|errore interno|errore del server|si è verificato un errore|sessione scaduta|riprova più tardi|riprovare più tardi|servizio non disponibile|in manutenzione|non trovata|non autorizzato)
(página|a página|o documento|o arquivo|o ficheiro) (não encontrada|não encontrado|não existe|não foi encontrada|não está disponível|indisponível)
(acesso negado|erro interno|erro do servidor|ocorreu um erro|encontrou um erro|sessão expirada|tente novamente|tente mais tarde|serviço indisponível|em manutenção|não encontrada|sem permissão)
(pagina niet gevonden|toegang geweigerd|er is een fouten opgetreden|er is een fout opgetreden|interne serverfout|niet beschikbaar|probeer het later|sessie verlopen|bestaat niet meer|in onderhoud)
(nie znaleziono|strona nie istnieje|dostęp zabroniony|brak dostępu|odmowa dostępu|wystąpił błąd|błąd serwera|wewnętrzny błąd|spróbuj ponownie|sesja wygasła|usługa niedostępna|przerwa techniczna)
(sidan hittades inte|sidan kunde inte hittas|åtkomst nekad|ett fel uppstod|ett fel har inträffat|internt serverfel|försök igen senare|tjänsten är inte tillgänglig|sessionen har gått ut)
(sayfa bulunamadı|erişim engellendi|bir hata oluştu|sunucu hatası|daha sonra tekrar|oturum süresi doldu|hizmet kullanılamıyor)
(stránka nenalezena|stránka nebyla nalezena|přístup odepřen|došlo k chybě|chyba serveru|zkuste to později|služba není dostupná)
(страница не найдена|не найдена|не найден|страница не|доступ запрещен|доступ запрещён|доступ закрыт|произошла ошибка|внутренняя ошибка|ошибка сервера|ошибка 404|ошибка 50|попробуйте позже|повторите попытку|сервис недоступен|временно недоступ|сессия истекла|технические работы)
(找不到页面|页面不存在|页面未找到|未找到|无法访问|拒绝访问|访问被拒绝|没有权限|服务器错误|内部错误|服务不可用|出错了|发生错误|请稍后再试|请稍后重试|会话已过期|请重新登录|系统维护|正在维护)
(見つかりません|ページが見つかりませんでした|エラーが発生しました|アクセスが拒否|アクセス権限|権限がありません|サーバーエラー|内部エラー|サービスを利用できません|しばらくしてから|もう一度お試し|セッションが切れ|メンテナンス中|存在しません)
(페이지를 찾을 수 없|찾을 수 없습니다|접근이 거부|액세스가 거부|권한이 없습니다|오류가 발생|서버 오류|내부 오류|서비스를 사용할 수 없|나중에 다시|다시 시도해|세션이 만료|점검 중)"""
SCRIPT = """(enable|activate|allow|turn on|switch on|accept) (javascript|java script|js|scripts|script support|scripting|active scripting|cookies|script)
(javascript|js|scripts|scripting|script support|active scripting|cookies) (is disabled|is not enabled|is required|is turned off|is switched off|must be|is off|are disabled|are not enabled|are required|are turned off|are blocked|needs to be|need to be|has to be|disabled|required)
(requires|require|needs|depends on|requires that|relies on|has switched off|switched off|have to activate|have to enable|must enable|must allow|without|could not detect|to run this app, enable|does not support|doesn't support|not support) (javascript|java script|js|scripts|script support|active scripting|cookies|script)
(you need to enable|please enable|enable it in your browser|your browser does not|your browser is|browser is too old|browser is out of date|browser is not supported|unsupported browser|update your browser|upgrade your browser|update it and come back|browser settings and reload|cannot be shown without|does not work with scripts off|doesn't work properly without|works best with|checking your browser|checking if the site|just a moment|verify you are human|verifying you are human|verifying that you are human|verify that you are|are you a robot|you are not a robot|not a robot|complete the captcha|solve the captcha|security check|needs to review the security|redirected automatically|please stand by|please wait while|this may take|loading...|blocks scripts|noscript:|page requires|site needs|site requires|to continue, allow|in the help pages|ddos protection)
(aktivieren sie|bitte aktivieren|schalten sie|erlauben sie|muss aktiviert|benötigt|erfordert|ohne|ist deaktiviert|nutzen zu können) (javascript|scripts|cookies|skripte)
(javascript|cookies|skripte) (aktiviert sein|aktivieren|ist deaktiviert|deaktiviert|erforderlich|ist erforderlich|einschalten|zulassen|muss)
(activez|activer|veuillez activer|autorisez|autoriser|nécessite|requiert|sans|exige) (javascript|les scripts|les cookies|le javascript)
(javascript|les cookies|les scripts) (est désactivé|est requis|est nécessaire|doit être|sont désactivés|doivent être)
(active|activar|active el|habilite|habilitar|active los|permita|se necesita|requiere|necesita|sin|actívelos para|no admite) (javascript|scripts|cookies|los scripts|las cookies)
(javascript|las cookies|los scripts) (está desactivado|está deshabilitado|es necesario|debe estar|para ver|desactivados)
(attiva|attivare|abilita|abilitare|richiede|senza|consenti|serve) (javascript|i cookie|gli script)
(javascript|i cookie) (è disattivato|è disabilitato|è necessario|deve essere|disattivato)
(ative|ativar|ative o|habilite|habilitar|habilite o|requer|precisa de|sem|permita) (javascript|cookies|os scripts|os cookies)
(javascript|os cookies) (está desativado|está desabilitado|é necessário|deve estar|precisa estar)
(schakel|activeer|zet|vereist|heeft|zonder) (javascript|cookies|scripts);javascript (inschakelen|is uitgeschakeld|is vereist|aan)
(włącz|aktywuj|wymaga|bez) (javascript|obsługi javascript|cookies);javascript jest (wyłączony|wymagany)
(aktivera|slå på|kräver|utan|tillåt) (javascript|cookies|skript);javascript (är avstängt|krävs|måste)
javascript (etkinleştirin|devre dışı|gerekli|gerektirir);(povolte|zapněte|vyžaduje|bez) (javascript|javascriptu|cookies)
(включите|разрешите|требуется|необходим|нужен|без) (javascript|поддержку javascript|скрипты|cookies);javascript (отключен|отключён|выключен|необходим)
(启用|请启用|开启|開啟|需要|允许|禁用了) (javascript|cookie|脚本);(启用|请启用|开启|開啟|需要|允许|禁用了)(javascript|cookie|脚本);浏览器不支持;验证您是真人;安全检查;请稍候
(javascript を有効|javascriptを有効|javascript が無効|javascriptが無効|javascript が必要|javascriptが必要|cookie を有効|ブラウザを更新|ロボットではない|お待ちください)
(자바스크립트를 활성화|자바스크립트를 켜|javascript를 활성화|javascript를 사용|자바스크립트가 필요|쿠키를 허용|로봇이 아닙니다|잠시만 기다려)"""
FILLER = """(asdf asdf|aaaa bbbb|blah blah|qwer qwer|qwerty qwerty|foo bar baz|test test|xxxx xxxx|jumps over the lazy dog|the quick brown fox|heading one|heading two|body text body text)
(coming soon|more to come|to be announced|to follow|text to follow|content to follow|under construction|to be written|to be completed|to be added)
(click|tap|double-click) (here |)to (edit|add|change)
(sample|dummy|placeholder|example|filler|default|boilerplate|demo) (text|content|page|description|heading|title|paragraph|copy)
(text|content|description|title|summary|heading|image|caption|body|copy|name) (goes|comes|will go|will appear|will be added) (here|in this place|in this field|below|soon|later)
(your|the|a|some|more) (text|content|description|title|summary|heading|image|caption|message|logo|name) (goes here|goes in this place|here|will follow)
(write|type|add|insert|enter|put|paste|describe|fill in|replace|provide) (your|a short|a brief|an|a|some|this|the) (notes|text|summary|description|drawing|title|content|image|picture|heading|introduction|name|story|details|placeholder)
(in|into|at|for) this (field|box|place|point|space|section|spot) ;(replace|edit|delete|overwrite) this (text|paragraph|page|section|sentence|line|with);fill in this;fill this in;text about the;this is a sample;for layout purposes
(has not been|hasn't been|is yet to be|was never|will be) (written|filled|added|completed|provided)
(no content has been|no text has been|nothing has been) (added|written|entered|provided)
describe what the (function|method|class|page) does
(hier steht später|hier kommt|hier folgt|platzhaltertext|beispieltext|blindtext|mustertext|demnächst mehr|text folgt|inhalt folgt|in arbeit|in kürze|noch kein inhalt|hier text einfügen|text hier eingeben)
(texte à venir|contenu à venir|bientôt disponible|texte d'exemple|texte de remplissage|faux texte|en construction|votre texte ici|insérez votre texte|à compléter|saisissez votre)
(aquí va|aquí va el texto|contenido de ejemplo|texto de relleno|texto de ejemplo|texto de prueba|próximamente|en construcción|escriba aquí|su texto aquí|por completar|inserte su texto)
(testo segnaposto|testo di esempio|testo di prova|prossimamente|in costruzione|inserisci qui|il tuo testo|scrivi qui|contenuto in arrivo)
(texto de exemplo|texto de preenchimento|em breve|em construção|insira aqui|seu texto aqui|escreva aqui|conteúdo em breve)
(hier komt tekst|voorbeeldtekst|binnenkort beschikbaar|tekst volgt|in aanbouw);(przykładowy tekst|wkrótce|w budowie|tutaj wpisz|treść pojawi się);(exempeltext|kommer snart|text kommer|under uppbyggnad);(örnek metin|yakında|yapım aşamasında);(ukázkový text|již brzy|ve výstavbě)
(здесь будет текст|текст появится|пример текста|скоро здесь|страница в разработке|введите текст|текст-заполнитель|будет добавлено)
(此处填写|内容待补充|示例文本|敬请期待|即将推出|请输入内容|占位文本|建设中);(ここに文章|準備中|サンプルテキスト|ダミーテキスト|近日公開|ここに入力);(준비 중|샘플 텍스트|여기에 텍스트|내용을 입력|곧 공개)"""
NAVIGATION = """skip to (main content|content|navigation);powered by;contact | imprint;home | functions;sign in;log in;log out;sign up;register;menu;search;imprint;privacy;privacy policy;terms of use;terms of service;all rights reserved;cookie settings;back to top;home;about us;contact us;sitemap;next page;previous page
startseite;impressum;datenschutz;anmelden;suche;kontakt;accueil;mentions légales;connexion;rechercher;inicio;aviso legal;iniciar sesión;buscar;cerca;accedi;entrar;pesquisar;zoeken;inloggen;szukaj;zaloguj;sök;logga in;поиск;войти;главная;首页;登录;搜索;ホーム;ログイン;検索;홈;로그인;검색"""
#: The words that notices and filler are made of, whatever the sentence. The first line of each kind holds those
#: that an ordinary text hardly has.
ERROR_WORDS = """error errors forbidden unauthorized unauthorised unavailable oops maintenance timeout gateway offline expired denied unreachable fehler serverfehler verweigert wartung erreur introuvable indisponible refusé denegado mantenimiento errore negato manutenzione erro negado indisponível manutenção fout błąd fel hata chyba ошибка traceback exception interrupted abgelaufen scaduta caducada expirée expirada wygasła запрещён запрещен недоступен истекла удалена interdit prohibido
page pages site website document file resource url link address content server service request requested connection network gateway database access permission session incident administrator webmaster support team technical difficulties problem persists found find looking loaded load reload refresh displayed reached reach respond responded reported returned answer available temporarily currently temporary removed moved broken changed renamed deleted wrong went occurred encountered unexpected internal fatal bad please sorry try again later retry minutes seconds moment slow sign signed log login logged member contact notified told reference number code check wait went closed refused reset failed long took connect upstream gone missing invalid occurred processing process back soon
seite datei dokument angeforderte server dienst zugriff berechtigung sitzung abgelaufen anfrage gefunden aufgetreten bitte später erneut versuchen versuch laden geladen melden anmelden entschuldigung verfügbar erreichbar existiert gibt mehr interner fehlgeschlagen verbindung
page demandée serveur service accès session expirée requête trouvée existe survenue produite veuillez plus tard réessayez réessayer rechargez désolé disponible interne connexion
página documento archivo servidor servicio acceso sesión caducada solicitud encontrada encontrado existe producido ocurrido favor inténtelo nuevo más tarde vuelva intentarlo siento disponible interno conexión entrar
pagina documento richiesta server servizio accesso sessione scaduta trovata esiste verificato riprova riprovare tardi spiacenti disponibile interno
página pedido servidor serviço acesso sessão expirada encontrada encontrou existe ocorreu tente novamente tarde desculpe disponível interno
gevonden toegang geweigerd opgetreden probeer later opnieuw beschikbaar verlopen sessie pagina
znaleziono strona istnieje dostęp zabroniony wystąpił serwera spróbuj ponownie później sesja wygasła
sidan hittades hittas åtkomst nekad uppstod försök igen senare tjänsten tillgänglig
sayfa bulunamadı erişim oluştu sunucu tekrar sonra;stránka nenalezena nalezena přístup odepřen došlo serveru zkuste později
страница страницы странице существует удалена внутренняя ошибка доступу запрещена найдена найден доступ запрещен запрещён закрыт произошла сервера сервер сервис позже попробуйте повторите попытку недоступен временно запрошенная"""
SCRIPT_WORDS = """javascript js cookies scripts noscript captcha robot browser scripting ddos navegador navigateur browsereinstellungen przeglądarce przeglądarka webbläsare tarayıcı браузер браузере браузера
script scripts support active enable enabled disable disabled activate activated allow allowed turn turned switch switched off on required requires require needs need needed depends detect detected settings reload refresh continue proceed please view see use show shown display page site website app newer application work works properly human humans verify verifying verification security check checking moment wait loading load update upgrade old outdated supported unsupported version help pages learn happens nothing blocks blocked redirected automatically stand connection review before blocked allow
bitte aktivieren aktiviert aktivieren deaktiviert schalten einschalten erlauben zulassen seite sehen anzeigen nutzen können muss benötigt erforderlich einstellungen laden neu verwenden
veuillez activer activez activé désactivé autoriser autorisez requis nécessaire nécessite doit page voir afficher continuer utiliser
active activar activado desactivado habilite habilitar permita necesita necesario requiere debe página ver mostrar continuar favor
attiva attivare abilita abilitare attivato disattivato richiede necessario deve pagina vedere visualizzare continuare usare
ative ativar habilite habilitar ativado desativado requer necessário precisa deve página ver continuar usar
schakel inschakelen uitgeschakeld vereist pagina bekijken;włącz wymaga wymagany wyłączony stronę zobaczyć;aktivera slå krävs avstängt sidan visa;etkinleştirin gerekli sayfa görmek;povolte zapněte vyžaduje stránku
включите разрешите требуется необходим отключен выключен страницу просмотра увидеть поддержку настройках"""
FILLER_WORDS = """placeholder dummy lorem ipsum asdf qwer qwerty blah platzhaltertext blindtext próximamente
sample example text content description title summary heading paragraph caption image picture drawing notes message here goes go coming soon follow written write type add added insert enter edit click replace field box place point space section spot short brief construction under page fill your function parameters result describe does not been yet later layout purposes
hier text steht später inhalt folgt kommt demnächst mehr;texte contenu venir exemple bientôt construction;aquí texto contenido ejemplo relleno página;testo esempio qui;texto exemplo breve aqui;здесь будет текст скоро"""
#: Fixed value: the usual filler in Latin; each two neighbouring words of it are a phrase.
LATIN = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna
aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute
irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat
cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum at vero eos et accusam et justo duo
dolores et ea rebum stet clita kasd gubergren no sea takimata sanctus est lorem ipsum dolor sit amet consetetur sadipscing
elitr sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat sed diam voluptua"""
#: Words by which a sentence talks about notation rather than holding a hole.
ABOUT = """such as;written as;the marker;a marker;markers like;is replaced by;are replaced by;replaced with;substituted;expands to;expanded;template contains;templates;placeholder;placeholders;format string;syntax;for example;for instance;e.g.;looks like;notation;square brackets;curly brackets;brackets;variables;in the form;literally;left alone
zum beispiel;platzhalter;schreibweise;wird ersetzt;par exemple;est remplacé;marqueur;por ejemplo;se sustituye;marcador;ad esempio;segnaposto;por exemplo;bijvoorbeeld;na przykład;till exempel;например"""
#: Function words of several languages, which tell nothing about what a sentence is.
_FUNCTION_WORDS = frozenset("""the a an of to and or in on at by for from with into as if when while until because so that this these those it its is are was were be been has have had does do did not no you we our us your i he she they all each every any some one will would can could may might must should isn't aren't wasn't don't doesn't didn't can't cannot couldn't won't haven't hasn't this right now just here than then there what which who how up out off over only also very more most
der die das den dem des ein eine einen einer und oder ist sind war wurde werden wird nicht kein keine sie es wir ihr ihre zu zum zur mit für von auf aus bei nach um an im in als auch noch einmal diese dieser dieses konnte
le la les un une des du de et ou est sont a été n' ne pas plus cette ce ces vous nous votre notre à au aux pour par sur dans en que qui il elle se s' l' d'
el la los las un una unos de del y o es son ha sido no se su sus usted nosotros a al para por en con que este esta esto lo le ya
il lo la i gli le un una di del della e o è sono stato stata non si per con in su che questo questa al alla da
o a os as um uma de do da dos das e ou é são foi não se seu sua para por em no na com que este esta isto mais
de het een en of is zijn was niet er dit deze u uw wij ons voor met van op om te aan in
nie jest są być się w na z do i lub dla to ta ten tę aby ze
den det en ett och eller är var inte har du vi din för med på av att om i till kan
bir bu ve veya için ile de da değil;je jsou a nebo v na z do pro tato tuto se;и или в на не по для это эта этот мы вы ваш с к из у что""".replace(";", " ").split())

_NAMED = r"[A-Za-z_@][\w.\- ]*"
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*[#/^&>]?\s*{_NAMED}\s*\}}\}}|\$\{{\s*{_NAMED}\}}|\$\(\s*{_NAMED}\)|#\{{\s*{_NAMED}\}}|<%=?\s*{_NAMED}%>|\{{%\s*{_NAMED}%\}}|<<\s*{_NAMED}>>"
    rf"|(?<![\w%])%[A-Z][A-Z_.]{{2,}}%(?![\w%])|(?<![\w$])\$[A-Z][A-Z_]{{2,}}\$(?![\w$])|(?<!\w)__[A-Z][A-Z_]{{2,}}__(?!\w)|@@[A-Z_]{{2,}}@@|(?<!\w)X{{3,}}_[A-Z_]+_X{{3,}}(?!\w)|\[\[\s*[A-Z][A-Z_ ]+\]\]"
    rf"|\[\s*(?i:insert|enter|add|your|fill in|type|put)\b[^\[\]\n]+\](?!\()|\[[^\[\]\n]+\b(?i:goes here|here)\s*\](?!\()|<\s*(?i:your|insert|enter)\b[^<>\n]+>"
    rf"|\((?i:enter|insert|your|fill in)\b[^()\n]+\bhere\)|(?<![\w${{#(\[])\{{[a-z][a-z_.]{{2,}}\}}(?![\w}}])"
)
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_SPAN = re.compile(r"`[^`\n]*`")
#: A chart: its header and the lines of nodes, edges and blanks that follow.
_CHART = re.compile(rf"^[ \t]*(?:{CHART_HEADER.split()[0]}|graph) (?:TD|LR|TB|BT|RL)\b[^\n]*(?:\n[ \t]*(?:\w+(?:\(\[|\[\[|\{{|\[|\(|[ \t]*-->)[^\n]*)?(?=\n|\Z))*", re.M)
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|&nbsp;|&amp;")
_UNIT = re.compile(r"[^\n.!?。！？]+(?:[.!?。！？]+(?=\s|$|[^\x00-\x7f])|[.!?](?=\S)[^\n.!?。！？]*)*[.!?。！？]*")
_HINT = re.compile(r"[{<\[]|%[A-Z]|\$[A-Z]|__[A-Z]|@@|XXX|\$\(|\((?:enter|insert|your|fill|Enter|Insert|Your|Fill)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?(?![\w/])")
_QUOTED = re.compile(r"\"[^\"\n]+\"|“[^”\n]+”|„[^“\n]+“|«[^»\n]+»")
_WIDE = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]")
#: Lines of stack traces, and fields of an error object.
_TRACE = re.compile(r"^\s*(?:at [\w.$<>]+\([^)]*\)$|[\w.]*(?:Error|Exception)\b:?|File \"[^\"]*\", line \d+|Traceback\b|\{?\s*\"(?:status|error|code|message)\"\s*:)", re.I)
#: Names of code in a sentence: with an underscore or mixed case.
_CODE_NAME = re.compile(r"\b(?=\w*[a-z]_?[A-Z]|\w*_)\w+\b")


def loose(unit: str) -> bool:
    """Whether most words are numbers, one letter over and over, or the word before once more."""
    words = unit.lower().strip(" .!?").split()
    if len(words) < 3 or len(set(words)) > 0.75 * len(words) and not words[0].isdigit() and len(set(words[0])) > 1:
        return False
    odd = sum(w.isdigit() or (len(w) > 1 and len(set(w)) == 1) or w == before for before, w in zip(["", *words], words))
    return odd > 0.5 * len(words)


def expand(patterns: str) -> set[str]:
    """All texts of patterns: one a line or between `;`, with one of each (a|b)."""
    out = set()
    for line in patterns.split("\n"):
        for one in line.split(";"):
            parts = [p.split("|") if k % 2 else [p] for k, p in enumerate(re.split(r"\(([^()]*\|[^()]*)\)", one))]
            out |= {"".join(x).strip(" ") if not one.endswith(" ") else "".join(x).lstrip(" ") for x in product(*parts)}
    return out - {""}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All phrases, with E, S, F, N or A for error, script, filler, navigation and talk about notation."""
    a = ahocorasick.Automaton()
    for kind, phrases in (("N", NAVIGATION), ("A", ABOUT), ("F", FILLER), ("S", SCRIPT), ("E", ERROR)):
        for p in expand(phrases):
            a.add_word(p, (kind, len(p)))
    latin = LATIN.split()
    for p in {f"{x} {y}" for x, y in zip(latin, latin[1:])}:
        a.add_word(p, ("F", len(p)))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def vocabulary() -> tuple[dict[str, set[str]], dict[str, str]]:
    """The words of notices (error and script together) and of filler, and the kinds of those that an ordinary text hardly has."""
    words: dict[str, set[str]] = {"F": set(LATIN.split()), "N": set()}
    core: dict[str, str] = {}
    for kind, lists, phrases in (("F", FILLER_WORDS, FILLER), ("S", SCRIPT_WORDS, SCRIPT), ("E", ERROR_WORDS, ERROR)):
        lines = lists.replace(";", " ").split("\n")
        core |= dict.fromkeys(lines[0].split(), kind)
        words["F" if kind == "F" else "N"] |= {*" ".join(lines).split(), *_WORD.findall(" ".join(expand(phrases)))}
    return words | {"E": words["N"], "S": words["N"]}, core


def kind_of(sentence: str, found: list[str]) -> str | None:
    """E, S or F for a sentence that is residue, from the kinds of the phrases found in it, `-` for one that tells nothing, else None."""
    words, core = vocabulary()
    if loose(sentence):
        return "F"
    if _TRACE.match(sentence):
        return "E"
    own = [w for w in _WORD.findall(_CODE_NAME.sub(" ", sentence).lower()) if w not in _FUNCTION_WORDS]
    wide = len(_WIDE.findall(sentence))
    if wide and found and wide >= sum(len(w) for w in own if w.isascii() and w not in words[found[0]]):
        return found[0]  # scripts without blanks between words: a phrase is most of a sentence
    strong = found or [core[w] for w in own if w in core]
    if strong and sum(w in words[strong[0]] or strong[0] == "F" and len(set(w)) == 1 for w in own) >= (WITH_PHRASE if found else ALONE) * len(own) and (found or len(own) > 1):
        return strong[0]
    return "-" if all(w in words["E"] for w in own) or all(w in words["F"] for w in own) else None


def navigation(line: str, found: list[tuple[int, int]]) -> bool:
    """Whether phrases of navigation (start, length) make up half of a line, or begin one that is no sentence."""
    start, own = len(line) - len(line.lstrip()), line.strip()
    return 2 * sum(n for _, n in found) >= len(own) or own[-1] not in ".!?。" and any(s == start for s, _ in found)


def judge(text: str | None) -> str | None:
    """`placeholder`, `filler`, `error` or `script` for a text that is to be left out, else None."""
    if not text or text.isspace():
        return None
    seen = _CHART.sub("", _SPAN.sub("`", _FENCE.sub("\n", text)))
    low = seen.lower()
    if len(low) != len(seen):  # lower case of a few letters is longer
        seen = low
    hits = [(end - n + 1, end, kind) for end, (kind, n) in automaton().iter(low)]
    about = [s for s, _, k in hits if k == "A"]
    for m in PLACEHOLDER.finditer(seen) if _HINT.search(seen) else ():
        begin = max(seen.rfind(". ", 0, m.start()), seen.rfind("\n", 0, m.start())) + 1
        stops = [x for x in (seen.find(". ", m.end()), seen.find("\n", m.end())) if x >= 0]
        if not any(begin <= s < min([len(seen), *stops]) for s in about):
            return "placeholder"
    kinds: dict[str, int] = {}
    residue, rest = 0, max(0, len(text) - len(seen))  # code and charts are content
    clean = _TAG.sub(lambda m: "\n" * len(m.group()), seen)
    quoted = [m.span() for m in _QUOTED.finditer(clean)]
    marks = [h for h in hits if h[2] != "A" and not any(i <= h[0] and h[1] < j for i, j in quoted)]
    k, first = 0, True
    for unit in _UNIT.finditer(clean):
        own, stop = unit.group().strip(), unit.end()
        while k < len(marks) and marks[k][1] < unit.start():
            k += 1
        found, j = [], k
        while j < len(marks) and marks[j][1] < stop:
            if marks[j][0] >= unit.start():
                found.append(marks[j])
            j += 1
        if len(own) < 2:
            continue
        strong = None if "`" in own else kind_of(own, [x[2] for x in found if x[2] != "N"])
        if strong == "-":
            continue
        title = first and not strong and own[-1] not in ".!?。" and clean[stop : stop + 1] in ("\n", "")
        first = False
        if strong:
            residue += len(own)
            kinds[strong] = kinds.get(strong, 0) + len(own)
        elif not title and not navigation(unit.group(), [(s - unit.start(), e + 1 - s) for s, e, x in found if x == "N"]):
            rest += len(own)
            if rest > (1 - COVERED) * (rest + residue + len(clean) - stop):
                return None  # whatever follows, residue can't cover enough
    if residue and residue >= COVERED * (residue + rest):
        return {"E": "error", "S": "script", "F": "filler"}[max(kinds, key=lambda x: kinds[x])]
    return None


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `kind` of each document to leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = pa.array([judge(t) for t in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), kinds], names=[key, "kind"]).filter(kinds.is_valid())

    rows = widen(docs.select(key, text).where(f"`{text}` is not null and `{text}` != ''"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, kind string")
