"""Words by the number of their syllables."""

WORDS = {
    1: """the a me be she we make makes made like liked jumped called asked used moved tried drive drives through thought friend field piece chief
    bread each read sea road boat coal goal goat blue true fruit suit juice build guide guess guard quit queue school code large charge change
    league vague tongue join point choice voice eye eyes style while whole horse house house's don't can't won't years price team chip phone
    clear near bean clean real deal reed feel fire tired our hour cloud screen desk cut built kept shipped""",
    2: """people business science being quiet diet poem poet lion giant client create doing going seeing flying trying crying player beyond lawyer
    canyon table little able apple settle settled handled tables centre metre acre wanted needed boxes pages places uses lately careful careless
    movement homework framework firewall software something somewhere therefore every evening region nation action social special million
    billion brilliant union onion junior senior ocean value argue rescue lonely rarely isn't didn't doesn't couldn't fuel cruel fluid ruin duet
    pigeon surgeon gorgeous language penguin circuit biscuit pursuit naive chaos hundred sacred naked market window user supply apply July
    carriage marriage fashion cushion Russia bias via trial dial series species cookies movie machine engine rhythm prism spasm ancient patient
    soldier frontier female""",
    3: """idea area video theory theater media radio studio piano violin violent period stadium premium museum actual annual gradual poetry coalesce
    realize reaction creative created creation potential essential religious companion opinion religion complexion easier easiest barrier
    carrier supplier audience influence genuine suicide vacuum continue animal important family another remember completely settlement implement
    element industry government company enterprise understand everything everyone interface database familiar peculiar behavior heroic mosaic
    archaic finally agreement employee internet parliament linear nuclear initial musician magician efficient energy history impatient
    conversion diagnose employer financial governance heaviest deviant dialogue catalogue commercial commission committee determine delicious
    delicate courageous outrageous""",
    4: """information technology security reality variety society biology experience material superior interior January February operation organism
    mechanism cooperate coordinate negotiate associate appreciate initiate geography geometry European community especially economy category
    generation situation evaluate continuous intuition coalition automatic infrastructure legislation regulation activity ability historical
    environment military controversial administer analyzer appropriate application""",
    5: """university individual opportunity communication organization electricity possibility creativity negotiation appreciation simultaneous
    administration ambiguity administrative refrigerator international's imagination investigation multiplication mathematical capitalism
    enthusiasm""",
    6: """responsibility availability variability reliability""",
}
