"""Category rules: fixed values, kept as plain text in evaluation order.

``LABEL_RULES`` lists the categories in the order in which they are tested; that
order also breaks ties for the primary category. Every rule is a regular
expression tested on the lower-cased text without regard to case.
"""

# Category names in definition order.
CATEGORIES = [
    "hate_speech",
    "anti_immigration",
    "anti_lgbtq",
    "anti_feminism",
    "disinformation",
    "conspiracy_theory",
    "call_to_action",
    "nationalism",
    "anti_government",
    "historical_revisionism",
    "political_general",
    "general",
]

NO_MATCH = "non_political"
FAILED = "ERROR"

# Rules per category, in evaluation order.
LABEL_RULES = {
    "hate_speech": [
        r'\b(?:raza\s+inferior|sangre\s+pura|superioridad\s+racial)\b',
        r'\b(?:hay\s+que\s+|debemos\s+|vamos\s+a\s+|queremos\s+)?(?:eliminar|deportar|expulsar)\s+(?:a\s+)?(?:los?\s+|todas?\s+|todos\s+los?\s+)?(?:musulmanes?|gitanos?|moros?|negros?)\b',
        r'\b(?:musulmanes?|gitanos?|moros?|negros?)\b.*\b(?:hay\s+que\s+|debemos\s+|queremos\s+)?(?:eliminar|deportar|expulsar)(?:los)?(?:\s+a\s+todos?)?\b',
        r'\b(?:alimañas?|parásitos?|escoria|basura)\s+(?:musulman|gitana|mora|negra)',
        r'\b(?:invasión|plaga|epidemia)\s+(?:de\s+)?(?:musulmanes|moros|gitanos)',
        r'\b(?:tienes?\s+|eres\s+un[ao]?\s+)(?:orejas?|narizotas?|patas?\s+de\s+elefante|elefante|gorila|mono|chimpancé|cerdo|cerda|rata|basura|mierda|escoria|parásito|animal|monstruo)\b',
        r'(?:^|[.!?]\s+)(?:orejas?|narizotas?|gorila|mono|chimpancé|cerdo|cerda|rata|basura|mierda|escoria|parásito|animal|monstruo)(?:[,!?\s]+(?:tienes?|eres|te|tu|tus?|que|y|pero)\b)',
        r'\b(?:apoyo\s+la\s+|defiendo\s+la\s+)?(?:discriminación|segregación)\s+(?:de\s+|hacia\s+|contra\s+)(?:los?\s+)?(?:musulmanes|inmigrantes|gitanos)\b',
        r'\b(?:maricas?|maricones?)\b',
        r'\b(?:feminazis?)\b',
        r'\bfuera\s+(?:los?\s+|las?\s+)?(?:moros?|extranjeros?|ilegales?|inmigrantes?|menas?)\b',
        r'\b(?:moros?|extranjeros?|ilegales?|inmigrantes?|menas?)\s+fuera\s+(?:de\s+)?(?:España|Europa)\b',
        r'\b(?:expuls\w+|deport\w+)\s+(?:a\s+)?(?:los?\s+)?(?:moros?|extranjeros?|ilegales?)\b',
        r'\b(?:moros?|musulmanes?|inmigrantes?)\s+(?:nos\s+)?(?:están\s+)?(?:invadiendo|invaden)\b',
        r'\b(?:invasión|oleada|avalancha)\s+(?:de\s+)?(?:inmigrantes?|musulmanes?|moros?)\b',
        r'\b(?:nos\s+)?(?:están\s+)?(?:invadiendo|invaden)\s+(?:España|Europa|nuestro\s+país|nuestra\s+patria)\b',
        r'\b(?:inmigrantes?|extranjeros?|ilegales?|menas?)\b.*\b(?:saturan?|colapsan?|saturando|colapsando)\b.*\b(?:servicios?|sanidad|hospitales?|colegios?)\b',
        r'\b(?:servicios?|sanidad|hospitales?|colegios?)\b.*\b(?:saturad[oa]s?|colapsad[oa]s?)\b.*\b(?:inmigrantes?|extranjeros?|ilegales?)\b',
        r'\b(?:menos|sin)\s+(?:viviendas?|casas?|pisos?|médicos?|recursos?|ayudas?)\b.*\b(?:por\s+)?(?:culpa\s+de\s+|debido\s+a\s+)?(?:los?\s+)?(?:inmigrantes?|extranjeros?)\b',
        r'\b(?:inmigrantes?|extranjeros?)\b.*\b(?:nos\s+)?(?:quitan|roban|arrebatan)\b.*\b(?:viviendas?|trabajos?|empleos?|ayudas?|recursos?)\b',
        r'\b(?:españoles?)\b.*\b(?:condenados?|obligados?)\s+(?:a\s+)?(?:listas?\s+de\s+espera|esperar|sufrir)\b.*\b(?:inmigrantes?|extranjeros?)\b',
        r'\b(?:hacen|hacer)\s+negocio\s+(?:con\s+)?(?:trayéndolos?|importándolos?|ellos?)\b',
        r'\b(?:promover|promovido|promueven)\s+una\s+invasión\b',
        r'\b(?:traer|importar|meter)\s+(?:inmigrantes?|extranjeros?)\b',
        r'\b(?:los?\s+)?(?:traen|importan|meten)\b.*\b(?:inmigrantes?|extranjeros?)\b',
        r'\b(?:estos?\s+)?menas?\b.*\b(?:robar|traficar|delinquir|criminal\w*)\b',
        r'\b(?:harto|cansado)\s+(?:de\s+)?(?:estos?\s+)?(?:menas?|inmigrantes?|extranjeros?)\b',
        r'\bdevolvé[dr]los?\s+(?:a\s+)?(?:su\s+país|África|donde\s+vinieron)\b',
        r'\b(?:matar|asesinar|eliminar|acabar\s+con)\s+(?:a\s+)?(?:los?\s+)?(?:rojos|marxistas|separatistas)\b',
        r'\b(?:exterminio|eliminar|acabar\s+con)\s+(?:los\s+)?(?:rojos|marxistas|separatistas)\b',
        r'\b(?:colgar|fusilar|paredón|guillotina)\b',
        r'\b(?:racismo|xenofobia|homofobia)\b',
        r'\b(?:intolerancia|fanatismo|sectarismo)\b',
        r'\b(?:insulto|vejación|humillación)\b',
        r'\b(?:integración|asimilación)\s+(?:imposible|fracasada)\b',
        r'\b(?:guetos?|paralelas?)\s+(?:culturales?|religiosas?)\b',
        r'\b(?:violen(?:cia|to)|agresión|ataque)\b',
        r'\b(?:amenaza|amenazar|intimidar)\b',
        r'\b(?:armas?|armado|armamento)\b',
        r'\b(?:justicia|venganza)\s+(?:por\s+(?:su\s+)?propia\s+mano|popular)\b',
        r'\b(?:linchamiento|linchamient[oa])\b',
        r'\babr[óo]chate\s+las?\s+rodilleras?\b',
        r'\b(?:chúpame|mamame|métete)\s+(?:la|el)\s+(?:polla|verga|pito|cipote)\b',
        r'\b(?:ven\s+aquí|acércate)\s+(?:que\s+te\s+)?(?:follo|cojo|tíro|cogo)\b',
        r'\b(?:eres\s+)?(?:una\s+)?(?:puta|zorra|guarra|perra)\s+(?:caliente|folable|cachonda)\b',
        r'\b(?:me\s+)?(?:gustar[íi]a|encantar[íi]a)\s+(?:follar|tirar|coger)\s+(?:contigo|con\s+ella|con\s+vos)\b',
        r'\b(?:tienes?\s+)?(?:un\s+)?(?:culo|tetitas|pechugas|tetas)\s+(?:que\s+)?(?:está\s+)?(?:para\s+)?(?:follar|chupar|lamer)\b',
        r'@\w+\s+.*\b(?:abróchate|rodilleras?|polla|follar|coger|tirar)\b',
    ],
    "disinformation": [
        r'\b(?:esto\s+es\s+|es\s+pura\s+|típica\s+)?(?:desinformación|fake\s+news|noticias?\s+falsas?)\b(?!\s+(?:es\s+mala|debe\s+combatirse|hay\s+que\s+evitar))',
        r'\b(?:difunden|propagan|extienden)\s+(?:bulos?|rumores?|mentiras?)\b',
        r'\b(?:esto\s+es\s+un\s+|puro\s+|típico\s+)?(?:bulo|rumor)\b(?!\s+(?:es\s+falso|está\s+desmentido))',
        r'\b(?:es\s+)?(?:mentira|falsedad)\s+(?:que\s+)?(?:digan|afirmen|crean)\b',
        r'\b(?:campaña\s+de\s+|operación\s+de\s+)?(?:manipulación|tergiversación|distorsión)\b',
        r'\b(?:vacunas?|vacunación)\s+(?:con\s+)?(?:microchips?|chips?|5g|bill\s+gates|control\s+mental)',
        r'\b(?:vacunas?)\s+(?:tienen|contienen|llevan)\s+(?:microchips?|chips?|nanobots?)',
        r'\b(?:bill\s+gates)\s+(?:y\s+las\s+)?(?:vacunas?|control)',
        r'\b(?:covid|coronavirus)\s+(?:es\s+)?(?:mentira|falso|inexistente|inventado)',
        r'\b(?:plandemia|dictadura\s+(?:sanitaria|digital)|farmafia)\b',
        r'\b(?:grafeno)\b.*\b(?:controlarnos|control)\b',
        r'\b(?:5g)\b.*\b(?:controlarnos|control)\b',
        r'\b(?:vacunas?).*\b(?:grafeno|5g)\b',
        r'\b(?:\d+\s+de\s+cada\s+\d+)\s+(?:casos?)\s+(?:de\s+covid|son\s+inventados?)\b',
        r'\b(?:el\s+)?(?:100|90|80)\s*%\s+(?:de\s+)?(?:los\s+)?(?:médicos|científicos)\s+(?:están\s+)?(?:comprados?|sobornados?|pagados?)\b',
        r'\b(?:cero|0)\s+(?:muertes?|fallecidos?)\s+(?:por\s+)?(?:covid|coronavirus)\s+(?:real(?:es|mente)?|verdad)\b',
        r'\b(?:vacunas?|medicamentos?|tratamientos?)\s+(?:causan?|provocan?|generan?)\s+(\w+)',
        r'\b(?:covid|coronavirus|pandemia)\s+(?:es|fue|será)\s+(\w+)',
        r'\b(?:efectos?\s+(?:secundarios?|adversos?))\s+(?:de\s+)?(?:vacunas?)\s+(?:son\s+)?(?:ocultados?|negados?|minimizados?)\b',
        r'\b(?:inflación|desempleo|paro)\s+(?:real\s+)?(?:es\s+del?\s+|alcanza\s+el\s+)(?:50|60|70|80|90)\s*%',
        r'\b(?:cambio\s+climático|calentamiento\s+global)\s+(?:es\s+)?(?:mentira|falso|inexistente|inventado|hoax)\b',
        r'\b(?:inmigrantes?|extranjeros?)\s+(?:ya\s+)?(?:representan|son)\s+(?:más\s+del\s+|el\s+)?(?:50|60|70|80|90)\s*%\s+(?:de\s+la\s+población|de\s+los\s+habitantes)\b',
        r'\b(?:propaganda|adoctrinamiento|lavado\s+de\s+cerebro)\b',
        r'\b(?:censura|silenciamiento|ocultación)\b',
        r'\b(?:verdad\s+(?:oculta|alternativa)|realidad\s+alternativa)\b',
        r'\b(?:el\s+gobierno|gobierno)\s+(?:ha\s+aprobado|aprueba|ha\s+firmado|firma)\s+(?:un\s+)?decreto\b',
        r'\b(?:decreto\s+(?:aprobado|firmado|promulgado)|ley\s+aprobada)\s+(?:que\s+)?(?:prohíbe|obliga|impone|restringe)\b',
        r'\b(?:ya\s+está\s+(?:firmado|aprobado|promulgado)|ya\s+está\s+firmado)\s+(?:el\s+)?decreto\b',
        r'\b(?:ha\s+(?:sido\s+)?(?:destituido|cesado|dimiti[dt]o)|abandona\s+el\s+cargo)\s+(?:por|después\s+de)\b',
        r'\b(?:ministro|ministra|director|directora|líder\s+de\s+(?:la\s+)?oposición).*?(?:ha\s+(?:sido\s+)?)?(?:destituido|destituida|cesado|cesada|dimiti[dt]o|dimitida)\b',
        r'\b(?:exclusiva|confirmado)\s*:\s*(?:el\s+)?(?:líder|ministro|ministra|director|directora)\s+(?:ha\s+(?:sido\s+)?)?(?:destituido|cesado|dimiti[dt]o)\b',
        r'\b(?:ya\s+es\s+oficial|es\s+oficial|confirmado|según\s+fuentes\s+(?:oficiales?|del\s+gobierno))\b',
        r'\b(?:según\s+fuentes\s+del\s+(?:ministerio|palacio|gobierno))\s+(?:sin\s+especificar|que\s+no\s+quieren\s+identificarse)\b',
        r'\b(?:boe|boletín\s+oficial)\s+(?:ya\s+)?(?:publicado|publicada)\b(?!\s+(?:\d+|número|num\.|\d{1,2}/\d{4}))',
        r'\b(?:boe|boletín\s+oficial)\s+(?:ya\s+)?(?:publicado|publicada)\b(?!\s+(?:del?\s+)?\d{1,2}\s+de\s+\w+\s+de\s+\d{4})',
        r'ya\s+está\s+publicado\s+en\s+el\s+boe\b(?!\s+(?:\d+|número|num\.|\d{1,2}/\d{4}))',
        r'boe\s+ya\s+publicado\b(?!\s+(?:\d+|número|num\.|\d{1,2}/\d{4}))',
        r'\b(?:acuerdo\s+(?:secreto|confidencial)|pacto\s+secreto)\s+(?:con|entre)\b',
        r'\b(?:ha\s+firmado|firmó)\s+(?:un\s+)?acuerdo\s+(?:secreto|confidencial)\b',
        r'\b(?:obliga\s+a\s+(?:todos|todas)\s+(?:los\s+)?ciudadanos?\s+a|será\s+obligatorio)\b',
        r'\b(?:bajo\s+pena\s+de\s+(?:multa|sanciones?|castigo))\b',
        r'\b(?:cierra\s+(?:todas\s+)?(?:las\s+)?fronteras|cerrar\s+(?:todas\s+)?(?:las\s+)?fronteras)\b',
        r'\b(?:por\s+tiempo\s+indefinido|de\s+forma\s+permanente)\b',
        r'\b(?:dictadura\s+digital|imponen\s+(?:la\s+)?dictadura\s+digital|quieren\s+(?:una\s+)?dictadura\s+digital)\b',
    ],
    "conspiracy_theory": [
        r'\b(?:plan\s+kalergi|gran\s+reemplazo|reemplaz[oa]\s+populacional)\b',
        r'\b(?:nuevo\s+orden\s+mundial|deep\s+state|estado\s+profundo)\b',
        r'\b(?:soros|globalistas?|masoner[íi]a|illuminati|bilderberg)\b',
        r'\b(?:agenda\s+(?:2030|oculta)|gran\s+reset(?:eo)?)\b',
        r'\b(?:conspiración|complot|conjura)\b',
        r'\b(?:élite|oligarqu[íi]a)\s+(?:global|mundial|oculta)\b',
        r'\b(?:manipulación|control)\s+(?:mental|social)\b',
        r'\b(?:medios\s+(?:de\s+)?comunicación|prensa)\s+(?:manipulad[ao]|comprad[ao])\b',
    ],
    "anti_immigration": [
        r'\b(?:invasión|nos\s+están\s+inundando|nos\s+están\s+invadiendo)\b',
        r'\b(?:nos\s+están\s+borrando|nos\s+quieren\s+borrar|sustitución\s+cultural)\b',
        r'\b(?:gran\s+sustitución|teoría\s+de\s+la\s+sustitución)\b',
        r'\b(?:inmigrantes?\s+ilegales?|ilegales\s+inmigrantes?)\b',
        r'\b(?:control\s+de\s+fronteras?|fronteras\s+abiertas?|fronteras\s+protegidas?)\b',
        r'\b(?:nos\s+quitan\s+el\s+trabajo|nos\s+quitan\s+nuestros?\s+empleos?)\b',
        r'\b(?:carga\s+económica|nos\s+cuestan\s+mucho|nos\s+arruinan)\b',
        r'\b(?:vienen\s+a\s+vivir\s+de\s+nuestras?\s+prestaciones?)\b',
        r'\b(?:no\s+se\s+integran|no\s+quieren\s+integrarse)\b',
        r'\b(?:imponen\s+sus\s+costumbres|imponen\s+su\s+religión)\b',
        r'\b(?:compatibilidad\s+cultural|incompatible\s+culturalmente)\b',
    ],
    "anti_lgbtq": [
        r'\b(?:ideología\s+de\s+género|doctrina\s+de\s+género)\b',
        r'\b(?:agenda\s+lgbt|LGBT\s+nos\s+quiere|quieren\s+adoctrinar)\b',
        r'\b(?:quieren\s+convertir\s+a\s+nuestros?\s+hijos?|adoctrinamiento\s+infantil)\b',
        r'\b(?:van\s+a\s+por\s+los\s+niños?|van\s+a\s+por\s+nuestros?\s+hijos?)\b',
        r'\b(?:defensa\s+de\s+la\s+familia\s+tradicional)\b',
        r'\b(?:familia\s+tradicional\s+en\s+peligro|amenaza\s+a\s+la\s+familia)\b',
        r'\b(?:valores\s+cristianos?\s+atacados?|tradiciones\s+familiares)\b',
        r'\b(?:hombres\s+con\s+vestidos?|mujeres\s+con\s+pantalones?)\b',
        r'\b(?:biología\s+binaria|hay\s+solo\s+dos\s+géneros)\b',
        r'\b(?:deporte\s+femenino\s+contaminado|deporte\s+femenino\s+invadido)\b',
    ],
    "anti_feminism": [
        r'\b(?:feminazis?|feministas?\s+radicales?|feministas?\s+extremas?)\b',
        r'\b(?:feminismo\s+es\s+odio|el\s+feminismo\s+destruye)\b',
        r'\b(?:feminismo\s+radical|ideología\s+feminista)\b',
        r'\b(?:mujeres\s+en\s+casa|mujeres\s+para\s+la\s+cocina)\b',
        r'\b(?:hombres\s+proveedores?|mujeres\s+amas\s+de\s+casa)\b',
        r'\b(?:roles\s+tradicionales?\s+de\s+género)\b',
        r'\b(?:falsas\s+acusaciones?\s+de\s+violación|violación\s+falsa)\b',
        r'\b(?:caza\s+de\s+brujas\s+feminista|acoso\s+a\s+hombres)\b',
        r'\b(?:machismo\s+inverso|matriarcado\s+opresivo)\b',
    ],
    "call_to_action": [
        r'\b(?:movilizaos|organizaos|organicen|retirad|sacad|actuad\s+ya)\b',
        r'\b(?:todos\s+a\s+(?:las\s+calles|protestar|manifestar|movilizar))\b',
        r'\b(?:convocatoria|difunde\s+(?:esta|la)\s+(?:convocatoria|manifestación))\b',
        r'\b(?:concentración|manifestación|protesta|marcha)\s+(?:el\s+)?\w+',
        r'\b(?:boicot|boicotear|boicoteemos)\b',
        r'\b(?:revolución|rebelión|alzamiento|resistencia)\b',
        r'\b(?:a\s+las\s+calles|hay\s+que\s+actuar|salir\s+a\s+protestar)\b',
        r'\b(?:hagan\s+algo|hay\s+que\s+hacer\s+algo)\b',
        r'\b(?:no\s+(?:podemos|podéis)\s+quedarnos?\s+(?:de\s+)?brazos\s+cruzados)\b',
        r'\b(?:activismo|militancia|compromiso)\b',
        r'\b(?:organización|coordinación|planificación)\s+(?:de\s+)?(?:protesta|manifestación|movilización|acción|resistencia)\b',
    ],
    "nationalism": [
        r'\b(?:españa|europa)\s+(?:primero|por\s+encima\s+de\s+todo|antes\s+que\s+nada)\b',
        r'\b(?:españa|europa)\s+(?:para\s+los?\s+)?(?:españoles?|europeos?|autóctonos?|nativos?)\s+(?:solamente|sólo|únicamente)\b',
        r'\b(?:patria|patriotas?|patriot(?:a|ismo)|nación|nacional)\s+(?:verdader[ao]|auténtic[ao]|puri?[ao])\b',
        r'\b(?:identidad|esencia|raíces?|origen(?:es)?)\s+(?:española|nacional|racial)\s+(?:amenazada|en\s+peligro|atacada)\b',
        r'\b(?:pureza|autenticidad)\s+(?:española|nacional|racial|cultural)\b',
        r'\b(?:nosotros?\s+los?\s+)?(?:españoles?|autóctonos?|nativos?)\s+(?:somos\s+)?(?:superiores?|mejores?)\b',
        r'\b(?:soberan[íi]a|independencia)\s+(?:nacional|española)\s+(?:amenazada|en\s+peligro)\b',
        r'\b(?:hispanidad|españolidad)\s+(?:amenazada|perdida|recuperar)\b',
        r'\b(?:bandera|himno|símbolos?\s+nacional(?:es)?)\s+(?:españoles?|auténticos?|verdaderos?)\b',
        r'\b(?:reconquista|recuperar)\s+(?:españa|nuestra\s+patria|nuestro\s+país)\b',
        r'\b(?:tradición|tradiciones|ancestr(?:al|os))\s+(?:españoles?|auténtic[ao]s?|puri?[ao]s?)\b',
    ],
    "anti_government": [
        r'\b(?:régimen|dictadura|tiranía)\s+(?:de\s+)?(?:sánchez|socialista)\b',
        r'\b(?:gobierno|administración)\s+(?:corrupt[oa]|ilegítim[oa]|dictatorial)\b',
        r'\b(?:golpe\s+de\s+estado|derrocar|derribar)\s+(?:al\s+)?gobierno\b',
        r'\b(?:socialistas?|comunistas?|marxistas?|rojos?)\s+(?:han\s+)?(?:destruido|destruyen|arruinado|arruinan)\s+(?:españa|el\s+país)',
        r'\b(?:agenda|ideología)\s+(?:marxista|comunista|progre)\s+(?:está\s+)?(?:destruyendo|infectando)',
        r'\b(?:estado\s+profundo|deep\s+state)\b',
        r'\b(?:traición|traidor|vendepat(?:ria|rias))\b',
        r'\b(?:oposición|resistencia|contestación)\b',
        r'\b(?:democracia|libertad|derechos)\s+(?:amenazad[ao]|en\s+peligro)\b',
        r'\b(?:sistema|instituciones?)\s+(?:podrid[ao]|corrupt[ao]|ilegítim[ao])\b',
        r'\b(?:los\s+que\s+mandan|élites?|casta\s+política)\s+(?:no\s+)?(?:representan?|son)\b',
        r'\b(?:desde\s+dentro|por\s+dentro)\s+(?:está|están)\s+(?:podrid[ao]|corrupt[ao])\b',
        r'\b(?:no\s+representan?\s+al\s+pueblo|pueblo\s+real)\b',
        r'\b(?:deslegitimación|ilegítim[ao]|ilegítim[ao])\b',
    ],
    "historical_revisionism": [
        r'\b(?:franco|franquismo)\s+(?:fue\s+)?(?:necesario|salvador|salvó|héroe|gran\s+líder|mejor)\b',
        r'\b(?:dictadura|régimen)\s+(?:franquista|de\s+franco)\s+(?:fue\s+)?(?:mejor|próspera|gloriosa)\b',
        r'\b(?:valle\s+de\s+los\s+caídos|fundación\s+franco)\b',
        r'\b(?:con\s+)?franco\s+(?:se\s+)?(?:vivía|estaba|iba)\s+mejor\b',
        r'\b(?:república|guerra\s+civil)\s+(?:fue\s+)?(?:criminal|marxista|comunista)\b',
        r'\b(?:víctimas\s+(?:del\s+)?franquismo)\s+(?:son\s+)?(?:mentira|exageradas?)\b',
        r'\b(?:historia\s+oficial|historia\s+manipulada)\s+(?:nos\s+)?(?:oculta|esconde|manipula)\b',
        r'\b(?:contar\s+los\s+hechos\s+reales|verdad\s+histórica)\b',
        r'\b(?:memoria\s+histórica)\s+(?:es\s+)?(?:sectaria|revanchista)\b',
        r'\b(?:leyenda\s+negra|historia\s+manipulada)\b',
        r'\b(?:historia\s+incompleta|historia\s+que\s+nos\s+enseñaron)\b',
        r'\b(?:hechos\s+que\s+nos\s+ocultaron|verdad\s+oculta)\b',
        r'\b(?:manipulación\s+histórica|reescritura\s+de\s+la\s+historia)\b',
        r'\b(?:versión\s+oficial|historia\s+establecida)\s+(?:es\s+)?(?:falsa|mentirosa)\b',
    ],
    "political_general": [
        r'\b(?:elecciones?|votar|sufragio|electoral)\b',
        r'\b(?:partidos?\s+políticos?|coalición|alianza)\b',
        r'\b(?:congreso|senado|parlamento|cortes)\b',
        r'\b(?:constitución|ley\s+electoral|jurídico\s+político)\b',
        r'\b(?:gobierno\s+(?:de\s+)?(?:españa|nacional|central|autonómico))\b',
        r'\b(?:política\s+(?:exterior|interior|económica|social))\b',
        r'\b(?:palestina|gaza|cisjordania|territorios\s+ocupados?|bloqueo\s+de\s+gaza)\b',
        r'\b(?:flotilla\s+(?:de\s+las?\s+)?(?:libertad|solidaridad|humanitaria|tentaciones)|freedom\s+flotilla)\b',
        r'\b(?:ayuda\s+humanitaria|bloqueo\s+humanitario|genocidio\s+en\s+gaza)\b',
        r'\b(?:apartheid\s+israelí|crímenes\s+de\s+guerra|ocupación\s+ilegal)\b',
        r'\b(?:derechos\s+humanos\s+en\s+palestina|solidaridad\s+con\s+palestina)\b',
        r'\b(?:boicot\s+a\s+israel| BDS |movimiento\s+BDS )\b',
        r'\b(?:libertad\s+para\s+palestina|palestina\s+libre|free\s+palestine)\b',
        r'\b(?:intifada|resistencia\s+palestina|defensa\s+de\s+gaza)\b',
        r'\b(?:solidaridad\s+internacional|ayuda\s+humanitaria\s+internacional)\b',
        r'\b(?:derechos\s+humanos\s+internacionales?|convención\s+de\s+ginebra)\b',
        r'\b(?:crímenes\s+de\s+guerra|genocidio|corte\s+penal\s+internacional)\b',
    ],
}

# Keywords reported for a detected category.
CATEGORY_KEYWORDS = {
    "hate_speech": ['odio', 'racismo', 'discriminación', 'xenofobia', 'violencia', 'amenaza', 'acoso', 'sexual', 'objeticación', 'innuendo'],
    "disinformation": ['desinformación', 'bulo', 'mentira', 'manipulación', 'vacunas', 'covid', 'estadísticas', 'estudios', 'decreto', 'oficial', 'confirmado', 'fuentes', 'gobierno', 'aprobado', 'firmado'],
    "conspiracy_theory": ['conspiración', 'élite', 'soros', 'agenda'],
    "anti_immigration": ['inmigración', 'invasión', 'fronteras', 'sustitución', 'ilegales'],
    "anti_lgbtq": ['lgbt', 'género', 'trans', 'familia', 'tradicional', 'niños'],
    "anti_feminism": ['feminismo', 'feminazi', 'género', 'machismo', 'tradicional'],
    "call_to_action": ['movilización', 'protesta', 'manifestación', 'boicot'],
    "nationalism": ['nacionalismo', 'patria', 'identidad', 'soberanía', 'españoles superiores'],
    "anti_government": ['régimen', 'dictadura', 'gobierno', 'traición', 'sistema', 'podrido', 'socialistas', 'rojos'],
    "historical_revisionism": ['franco', 'franquismo', 'dictadura', 'memoria', 'historia', 'manipulada'],
    "political_general": ['política', 'gobierno', 'democracia', 'elecciones', 'palestina', 'gaza', 'solidaridad', 'humanitaria', 'derechos humanos'],
}

# Category descriptions.
CATEGORY_DESCRIPTIONS = {
    "hate_speech": 'Hate speech, xenophobia, violent threats, and sexual harassment targeting specific groups or individuals',
    "disinformation": 'False information including health, statistical, and factual disinformation',
    "conspiracy_theory": 'Conspiracy theories and hidden agenda narratives',
    "anti_immigration": 'Anti-immigration rhetoric and xenophobia',
    "anti_lgbtq": 'Anti-LGBTQ rhetoric and gender ideology attacks',
    "anti_feminism": 'Anti-feminism and traditional gender role promotion',
    "call_to_action": 'Calls to action and mobilization',
    "nationalism": 'Nationalist rhetoric emphasizing national superiority or identity threats',
    "anti_government": 'Anti-government rhetoric and delegitimization',
    "historical_revisionism": 'Historical revisionism and dictatorship rehabilitation',
    "political_general": 'General political content including international solidarity and humanitarian issues',
}

# Fixed values: (entity kind, name) in report order.
ENTITIES = [
    ("personas", "sánchez"),
    ("personas", "iglesias"),
    ("personas", "abascal"),
    ("personas", "casado"),
    ("personas", "rivera"),
    ("personas", "díaz ayuso"),
    ("personas", "franco"),
    ("personas", "hitler"),
    ("personas", "mussolini"),
    ("personas", "soros"),
    ("personas", "bill gates"),
    ("partidos", "psoe"),
    ("partidos", "pp"),
    ("partidos", "vox"),
    ("partidos", "podemos"),
    ("partidos", "ciudadanos"),
    ("partidos", "falange"),
    ("partidos", "democracia nacional"),
    ("partidos", "hogar social"),
    ("organizaciones", "eu"),
    ("organizaciones", "ue"),
    ("organizaciones", "otan"),
    ("organizaciones", "onu"),
    ("organizaciones", "fmi"),
    ("organizaciones", "davos"),
    ("organizaciones", "bilderberg"),
]
ENTITY_LIMIT = 10
