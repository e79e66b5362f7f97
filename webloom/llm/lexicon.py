"""Fixed word lists of general knowledge in the four languages of the corpus."""

from __future__ import annotations

#: Commonest function words by language.
FUNCTION_WORDS = {
    "en": (
        "the a an of to and in is it that i was for on with as be at by this not but or from have had you are they which one he she we if so my me all no "
        "there would what who how when only about into than then its been some any can could should will do does did has his her their our your these those most more very"
    ).split(),
    "fr": (
        "le la les de des du un une et est en que qui pour pas dans ce se sur au aux avec il elle on je nous vous ne plus par sa son ses cette ces mais ou où si "
        "très tout être avoir fait a été sans chez leur mon ma notre"
    ).split(),
    "de": (
        "der die das und ist ein eine einen einem einer den dem des in im zu von mit auf für nicht auch sich es ich wir ihr er sie man hat haben war wie nur noch "
        "so aus bei nach an am aber oder wenn dass als vor über um sehr kann"
    ).split(),
    "es": (
        "el la los las de del un una y en que es por para con no se lo al como más pero su sus le ya o este esta muy sin sobre me mi hay si cuando también hasta "
        "donde quien desde todo nos ser son fue"
    ).split(),
}

#: Words by which shop and product keywords are varied.
SHOP_WORDS = (
    "buy cheap sale price prices discount wholesale deal deals best top online original reviews review shipping free shop store order offer offers coupon promo outlet bargain "
    "acheter cher soldes prix avis ligne meilleur meilleure livraison gratuite boutique commander offre remise "
    "kaufen billig günstig angebot angebote preis preise rabatt test bestellen versand kostenlos beste "
    "comprar barato barata oferta ofertas precio precios rebajas línea envío gratis mejor mejores tienda descuento opiniones"
).split()
