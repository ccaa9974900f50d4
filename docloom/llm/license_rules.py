"""The signatures of the license scan: one rule a line, ``priority confidence label keywords: pattern``.

A pattern is a regex over lower-cased words (runs of a-z, 0-9 and letters beyond ASCII) joined by single spaces, and
matches whole words. Keywords are what stands in everything the pattern matches: ``a|b&c`` is a or b, and c; _ is a space. Priorities: 0 a machine-readable
identifier, 1 a version's full name or a license's own text, 2 a grant, 3 an identifier with its version, 4 a name, 5 a
phrase of several licenses, 9 a sign of some license.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A signature: smaller priorities win; ``confidence`` is what a detection adds to a text's score."""

    label: str
    keywords: str
    pattern: str
    priority: int
    confidence: float

    def gate(self) -> list[list[str]]:
        """The keywords: one of each list stands in every match."""
        return [x.replace("_", " ").split("|") for x in self.keywords.split("&")]


SIGNATURES = r"""
0 1.0 mit spdx: spdx licen[cs]e identifier mit(?: 0)?
0 1.0 apache spdx: spdx licen[cs]e identifier apache(?: \d(?: \d)?)?
0 1.0 gpl spdx: spdx licen[cs]e identifier gpl(?: \d(?: \d)?)?(?: or later| only)?
0 1.0 lgpl spdx: spdx licen[cs]e identifier lgpl(?: \d(?: \d)?)?(?: or later| only)?
0 1.0 agpl spdx: spdx licen[cs]e identifier agpl(?: \d(?: \d)?)?(?: or later| only)?
0 1.0 bsd spdx: spdx licen[cs]e identifier (?:0bsd|bsd(?: [0-4] clause)?)
0 1.0 mpl spdx: spdx licen[cs]e identifier mpl(?: \d(?: \d)?)?
0 1.0 epl spdx: spdx licen[cs]e identifier epl(?: \d(?: \d)?)?
0 1.0 cddl spdx: spdx licen[cs]e identifier cddl(?: \d(?: \d)?)?
0 1.0 eupl spdx: spdx licen[cs]e identifier eupl(?: \d(?: \d)?)?
0 1.0 isc spdx: spdx licen[cs]e identifier isc
0 1.0 zlib spdx: spdx licen[cs]e identifier zlib(?: acknowledgement)?
0 1.0 boost spdx: spdx licen[cs]e identifier bsl(?: 1 0)?
0 1.0 busl spdx: spdx licen[cs]e identifier busl(?: 1 1)?
0 1.0 unlicense spdx: spdx licen[cs]e identifier unlicense
0 1.0 wtfpl spdx: spdx licen[cs]e identifier wtfpl
0 1.0 artistic spdx: spdx licen[cs]e identifier artistic(?: \d(?: \d)?)?
0 1.0 python spdx: spdx licen[cs]e identifier (?:psf|python)(?: \d(?: \d)?)?
0 1.0 php spdx: spdx licen[cs]e identifier php(?: \d(?: \d+)?)?
0 1.0 ruby spdx: spdx licen[cs]e identifier ruby
0 1.0 ofl spdx: spdx licen[cs]e identifier ofl(?: \d \d)?
0 1.0 osl spdx: spdx licen[cs]e identifier osl(?: \d \d)?
0 1.0 odbl spdx: spdx licen[cs]e identifier odbl(?: \d \d)?
0 1.0 sspl spdx: spdx licen[cs]e identifier sspl(?: \d \d)?
0 1.0 elastic spdx: spdx licen[cs]e identifier elastic(?: \d(?: \d)?)?
0 1.0 fdl spdx: spdx licen[cs]e identifier gfdl(?: \d \d)?(?: or later| only)?
0 1.0 ms-pl spdx: spdx licen[cs]e identifier ms pl
0 1.0 ms-rl spdx: spdx licen[cs]e identifier ms rl
0 1.0 ncsa spdx: spdx licen[cs]e identifier ncsa
0 1.0 zpl spdx: spdx licen[cs]e identifier zpl(?: \d \d)?
0 1.0 vim spdx: spdx licen[cs]e identifier vim
0 1.0 openssl spdx: spdx licen[cs]e identifier openssl
0 1.0 cecill spdx: spdx licen[cs]e identifier cecill(?: [abc]| \d \d)?
0 1.0 postgresql spdx: spdx licen[cs]e identifier postgresql
0 1.0 upl spdx: spdx licen[cs]e identifier upl(?: 1 0)?
0 1.0 afl spdx: spdx licen[cs]e identifier afl(?: \d \d)?
0 1.0 cc0 spdx: spdx licen[cs]e identifier cc0(?: 1 0)?
0 1.0 cc-by spdx: spdx licen[cs]e identifier cc by(?: \d \d)?
0 1.0 cc-by-sa spdx: spdx licen[cs]e identifier cc by sa(?: \d \d)?
0 1.0 cc-by-nd spdx: spdx licen[cs]e identifier cc by nd(?: \d \d)?
0 1.0 cc-by-nc spdx: spdx licen[cs]e identifier cc by nc(?: \d \d)?
0 1.0 cc-by-nc-sa spdx: spdx licen[cs]e identifier cc by nc sa(?: \d \d)?
0 1.0 cc-by-nc-nd spdx: spdx licen[cs]e identifier cc by nc nd(?: \d \d)?
0 0.9 unknown spdx: spdx licen[cs]e identifier

1 1.0 mit permission_is_hereby: permission is hereby granted free of charge to any person obtaining a copy
1 0.95 mit permission_notice: the above copyright notice and this permission notice shall be included in all copies
1 0.9 mit expat_licen: (?:mit )?expat licen[cs]e
1 0.95 mit mit_x11: mit x11 licen[cs]e
1 1.0 apache licen: apache (?:software )?licen[cs]e (?:v|ver|version )?2(?: 0)?
1 1.0 apache licen: apache (?:software )?licen[cs]e (?:v|ver|version )?1(?: [01])
1 0.95 apache licen: you may not use this file except in compliance with the licen[cs]e
1 0.9 apache licen: may obtain a copy of the licen[cs]e at http www apache org licen[cs]es licen[cs]e 2 0
1 0.8 apache distributed&warranties: distributed on an as is basis without warranties or conditions of any kind
1 1.0 gpl general_public: gnu general public licen[cs]e (?:v|ver|version )?[123](?: 0)?(?: or later| only)?
1 1.0 gpl general_public: general public licen[cs]e (?:v|ver|version )?[123](?: 0)?(?: or later| only)?
1 0.95 gpl redistribute_it: free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
1 0.9 gpl general_public: gnu general public licen[cs]e as published by the free software foundation
1 0.9 gpl general_public: received a copy of the gnu general public licen[cs]e
1 1.0 lgpl lesser_general: gnu lesser general public licen[cs]e (?:v|ver|version )?[23](?: [01])?(?: or later| only)?
1 1.0 lgpl library_general: gnu library general public licen[cs]e(?: (?:v|ver|version )?2(?: 0)?)?
1 0.95 lgpl lesser_general: lesser general public licen[cs]e
1 0.9 lgpl lesser_general: received a copy of the gnu lesser general public licen[cs]e
1 1.0 agpl affero: gnu affero general public licen[cs]e (?:v|ver|version )?[13](?: 0)?(?: or later| only)?
1 0.95 agpl affero: affero general public licen[cs]e
1 0.9 agpl affero: received a copy of the gnu affero general public licen[cs]e
1 1.0 fdl free_documentation: gnu free documentation licen[cs]e(?: (?:v|ver|version )?1 [123])?
1 0.8 fdl free_documentation: free documentation licen[cs]e
1 0.9 fdl invariant: with no invariant sections no front cover texts and no back cover texts
1 1.0 bsd redistribution: redistribution and use in source and binary forms with or without modification
1 0.9 bsd redistributions: redistributions of source code must retain the above copyright notice
1 0.9 bsd redistributions: redistributions in binary form must reproduce the above copyright notice
1 0.9 bsd endorse&contributors: neither the name of .{1,80} nor the names of its contributors may be used to endorse or promote
1 0.95 bsd advertising_materials: all advertising materials mentioning features or use of this software must display
1 0.95 bsd clause&bsd: (?:zero|two|three|four|[0234]) clause bsd(?: licen[cs]e)?
1 0.95 bsd clause&bsd: bsd (?:zero|two|three|four|[0234]) clause(?: licen[cs]e)?
1 0.9 bsd bsd: (?:new|modified|revised|simplified|original|free) bsd licen[cs]e
1 1.0 mpl mozilla: mozilla public licen[cs]e (?:v|ver|version )?[12](?: [01])?
1 0.95 mpl mozilla: source code form is subject to the terms of the mozilla public licen[cs]e
1 1.0 epl eclipse: eclipse public licen[cs]e (?:v|ver|version )?[12](?: 0)?
1 0.9 epl eclipse: eclipse distribution licen[cs]e(?: (?:v|ver|version )?1(?: 0)?)?
1 1.0 cddl common_development: common development and distribution licen[cs]e(?: (?:v|ver|version )?1 [01])?
1 1.0 cpl common_public: common public licen[cs]e (?:v|ver|version )?1 0
1 1.0 eupl european_union_public: european union public licen[cs]e(?: (?:v|ver|version )?1 [012])?
1 1.0 isc permission_to_use: permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee
1 1.0 zlib altered: altered source versions must be plainly marked as such
1 0.9 zlib misrepresented: origin of this software must not be misrepresented
1 0.7 zlib implied_warranty: this software is provided as is without any express or implied warranty
1 0.9 zlib zlib: zlib libpng licen[cs]e
1 1.0 boost boost&licen: boost software licen[cs]e(?: (?:v|ver|version )?1(?: 0)?)?
1 1.0 artistic artistic_licen: artistic licen[cs]e (?:v|ver|version )?[12](?: 0)?
1 0.9 artistic artistic_licen: (?:perl|clarified) artistic licen[cs]e
1 1.0 python python&licen: python software foundation licen[cs]e(?: (?:v|ver|version )?2(?: 0)?)?
1 0.9 python beopen: beopen python open source licen[cs]e agreement
1 1.0 php php_licen: php licen[cs]e (?:v|ver|version )?[23](?: 0| 01)?
1 0.9 openssl openssl: this product includes software developed by the openssl project
1 1.0 unlicense unencumbered: this is free and unencumbered software released into the public domain
1 1.0 wtfpl fuck: do what the fuck you want to public licen[cs]e
1 1.0 ofl open_font: sil open font licen[cs]e(?: (?:v|ver|version )?1(?: [01])?)?
1 0.9 ofl open_font: open font licen[cs]e
1 1.0 osl open_software: open software licen[cs]e (?:v|ver|version )?[123](?: [01])?
1 0.9 afl academic_free: academic free licen[cs]e(?: (?:v|ver|version )?[123](?: [01])?)?
1 1.0 odbl database_licen: open (?:data commons open )?database licen[cs]e(?: (?:v|ver|version )?1 0)?
1 0.95 odc-by data_commons: open data commons attribution licen[cs]e
1 0.95 pddl data_commons: open data commons public domain dedication
1 1.0 ms-pl microsoft: microsoft public licen[cs]e
1 1.0 ms-rl microsoft: microsoft reciprocal licen[cs]e
1 1.0 sspl server_side: server side public licen[cs]e(?: (?:v|ver|version )?1)?
1 1.0 busl business_source: business source licen[cs]e(?: (?:v|ver|version )?1 [01])?
1 1.0 elastic elastic_licen: elastic licen[cs]e (?:v|ver|version )?[12](?: 0)?
1 1.0 ncsa ncsa: (?:university of illinois )?ncsa open source licen[cs]e
1 1.0 zpl zope: zope public licen[cs]e(?: (?:v|ver|version )?[12](?: [01])?)?
1 1.0 llama llama: llama (?:2|3|3 1|3 2|4) community licen[cs]e(?: agreement)?
1 0.95 llama llama: llama community licen[cs]e(?: agreement)?
1 0.95 openrail rail|responsible_ai: (?:creativeml|bigscience|bigcode) (?:open ?rail|rail)(?: [mds])?(?: licen[cs]e)?
1 0.9 openrail rail|responsible_ai: responsible ai licen[cs]e
1 1.0 cecill cecill: cecill (?:free software )?licen[cs]e(?: agreement)?(?: version [12](?: [01])?)?
1 0.95 postgresql postgresql: postgresql licen[cs]e
1 0.95 upl universal_permissive: universal permissive licen[cs]e(?: (?:v|ver|version )?1 0)?
1 0.95 qpl q_public: q public licen[cs]e
1 0.95 sleepycat sleepycat: sleepycat licen[cs]e
1 0.9 json not_evil: the software shall be used for good not evil
1 0.9 beerware beer&licen: beer ?ware licen[cs]e
1 0.9 cc0 creative_commons: creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?(?: licen[cs]e)?
1 0.95 cc-by creative_commons: creative commons attribution(?: (?:v|ver|version )?[1234](?: [05])?)?(?: international| unported| generic)?(?: licen[cs]e)?
1 0.95 cc-by-sa creative_commons: creative commons attribution share ?alike(?: (?:v|ver|version )?[1234](?: [05])?)?(?: international| unported| generic)?(?: licen[cs]e)?
1 0.95 cc-by-nd creative_commons: creative commons attribution no ?deriv(?:ative)?s(?: (?:v|ver|version )?[1234](?: [05])?)?(?: international| unported| generic)?(?: licen[cs]e)?
1 0.95 cc-by-nc creative_commons: creative commons attribution non ?commercial(?: (?:v|ver|version )?[1234](?: [05])?)?(?: international| unported| generic)?(?: licen[cs]e)?
1 0.95 cc-by-nc-sa creative_commons: creative commons attribution non ?commercial share ?alike(?: (?:v|ver|version )?[1234](?: [05])?)?(?: international| unported| generic)?(?: licen[cs]e)?
1 0.95 cc-by-nc-nd creative_commons: creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: (?:v|ver|version )?[1234](?: [05])?)?(?: international| unported| generic)?(?: licen[cs]e)?

2 0.9 mit under&mit: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?mit(?: licen[cs]e)?
2 0.9 apache under&apache|asl: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:apache(?: software)?|asl)(?: licen[cs]e)?(?: 2(?: 0)?)?
2 0.9 gpl under&gpl|general_public: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:gnu )?(?:gpl|general public)(?: licen[cs]e)?(?: v?[123](?: 0)?)?
2 0.9 lgpl under&lgpl|general_public: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:gnu )?(?:lgpl|(?:lesser|library) general public)(?: licen[cs]e)?(?: v?[23](?: [01])?)?
2 0.9 agpl under&agpl|affero: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:gnu )?(?:agpl|affero general public)(?: licen[cs]e)?(?: v?3(?: 0)?)?
2 0.9 bsd under&bsd: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:a )?bsd(?: style)?(?: licen[cs]e)?
2 0.9 mpl under&mpl|mozilla: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:mpl|mozilla public)(?: licen[cs]e)?(?: v?[12](?: [01])?)?
2 0.9 epl under&epl|eclipse: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:epl|eclipse public)(?: licen[cs]e)?
2 0.9 cddl under&cddl: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?cddl(?: licen[cs]e)?
2 0.9 eupl under&eupl: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?eupl(?: licen[cs]e)?
2 0.9 isc under&isc: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?isc(?: licen[cs]e)?
2 0.9 zlib under&zlib: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?zlib(?: licen[cs]e)?
2 0.9 boost under&boost: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?boost(?: software)?(?: licen[cs]e)?
2 0.9 unlicense under&unlicense: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?unlicense
2 0.9 wtfpl under&wtfpl: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?wtfpl(?: licen[cs]e)?
2 0.9 artistic under&artistic: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?artistic(?: licen[cs]e)?
2 0.9 python under&psf|python: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:psf|python software foundation|python)(?: licen[cs]e)?
2 0.9 php under&php: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?php licen[cs]e
2 0.9 ofl under&ofl|open_font: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:sil )?(?:ofl|open font)(?: licen[cs]e)?
2 0.9 odbl under&odbl|open_database: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:odbl|open database)(?: licen[cs]e)?
2 0.9 sspl under&sspl: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?sspl
2 0.9 openrail under&rail: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?open ?rail(?: [mds])?(?: licen[cs]e)?
2 0.9 fdl under&fdl: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:gnu )?(?:gfdl|fdl)
2 0.9 cc0 under&cc0: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:a )?cc0(?: licen[cs]e)?
2 0.85 creative-commons under&creative_commons: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:a )?creative commons(?: licen[cs]e)?
2 0.9 proprietary under&proprietary|commercial: (?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of the )?(?:a )?(?:proprietary|commercial) licen[cs]e
2 0.8 mit dual_licen: dual licen[cs]ed (?:under )?mit
2 0.8 apache licen: mit (?:or|and) apache(?: 2(?: 0)?)?(?: dual)? licen[cs]e

3 0.8 apache apache: apache (?:v|version )?(?:1 [01]|2(?: 0)?)
3 0.8 gpl gpl: gplv?(?: v)? ?[123](?: 0)?(?: or later| only)?
3 0.8 gpl gpl: gnu gpl
3 0.8 lgpl lgpl: lgplv?(?: v)? ?[23](?: [01])?(?: or later| only)?
3 0.8 lgpl lgpl: gnu lgpl
3 0.8 agpl agpl: agplv?(?: v)? ?[13](?: 0)?(?: or later| only)?
3 0.8 agpl agpl: gnu agpl
3 0.8 mpl mpl: mpl(?: v)? ?[12] [01]
3 0.8 epl epl: epl(?: v)? ?[12] 0
3 0.8 cddl cddl: cddl(?: v)? ?1 [01]
3 0.8 eupl eupl: eupl(?: v)? ?1 [012]
3 0.8 fdl gfdl: gfdl(?: 1 [123])?
3 0.8 boost bsl: bsl 1 0
3 0.8 busl busl: busl 1 1
3 0.8 ofl ofl: ofl 1 [01]
3 0.8 osl osl: osl [123] [01]
3 0.8 sspl sspl: sspl(?: v)? ?1(?: 0)?
3 0.8 odbl odbl: odbl(?: v)? ?1 0
3 0.8 bsd 0bsd: 0bsd
3 0.8 cc0 cc0: cc0(?: 1 0)?
3 0.8 cc-by cc_by: cc by [1234] [05]
3 0.8 cc-by-sa cc_by: cc by sa(?: [1234] [05])?
3 0.8 cc-by-nd cc_by: cc by nd(?: [1234] [05])?
3 0.8 cc-by-nc cc_by: cc by nc(?: [1234] [05])?
3 0.8 cc-by-nc-sa cc_by: cc by nc sa(?: [1234] [05])?
3 0.8 cc-by-nc-nd cc_by: cc by nc nd(?: [1234] [05])?

4 0.8 mit licen: mit licen[cs]ed?
4 0.8 apache licen: apache (?:software )?licen[cs]ed?
4 0.8 gpl general_public: (?:gnu )?general public licen[cs]e
4 0.8 gpl gpl: gpl(?:ed)?(?: licen[cs]ed?)?
4 0.8 lgpl lgpl: lgpl(?: licen[cs]ed?)?
4 0.8 agpl agpl: agpl(?: licen[cs]ed?)?
4 0.8 bsd bsd: bsd(?: style| like)? licen[cs]ed?
4 0.8 mpl mozilla: mozilla public licen[cs]e
4 0.8 mpl mpl: mpl licen[cs]ed?
4 0.8 epl eclipse: eclipse public licen[cs]e
4 0.8 epl epl: epl licen[cs]ed?
4 0.8 cddl cddl: cddl licen[cs]ed?
4 0.8 cpl common_public: common public licen[cs]e
4 0.8 eupl eupl: eupl licen[cs]ed?
4 0.8 isc licen: isc licen[cs]ed?
4 0.8 zlib zlib: zlib licen[cs]ed?
4 0.8 boost boost&licen: boost licen[cs]ed?
4 0.8 artistic artistic_licen: artistic licen[cs]ed?
4 0.8 python python&licen: python licen[cs]e
4 0.8 python licen: psf licen[cs]ed?
4 0.8 php php_licen: php licen[cs]e
4 0.8 ruby ruby_licen: ruby licen[cs]e
4 0.8 openssl openssl: openssl licen[cs]e
4 0.8 unlicense the_unlicense: the unlicense
4 0.8 wtfpl wtfpl: wtfpl(?: licen[cs]ed?)?
4 0.8 ofl ofl: (?:sil )?ofl licen[cs]ed?
4 0.8 osl open_software: open software licen[cs]e
4 0.8 elastic elastic_licen: elastic licen[cs]e
4 0.8 vim vim_licen: vim licen[cs]e
4 0.8 ncsa ncsa: ncsa licen[cs]e
4 0.8 openrail rail|responsible_ai: open ?rail(?: [mds])? licen[cs]e
4 0.7 creative-commons commons: creative commons(?: licen[cs]ed?)?
4 0.8 cc0 cc0: cc0 licen[cs]ed?

5 0.9 public-domain public_domain: (?:dedicated|released|placed) (?:to|into|in) the public domain
5 0.7 public-domain public_domain: public domain (?:dedication|work|software)
5 0.6 public-domain public_domain: (?:is|are) in the public domain
5 0.7 proprietary proprietary&confidential: proprietary and confidential
5 0.7 proprietary proprietary&confidential: confidential and proprietary
5 0.6 proprietary rights_reserved: all rights reserved
5 0.6 proprietary prohibited: (?:reproduction|copying|distribution|redistribution|use) (?:[^ ]+ ){0,6}is (?:strictly )?prohibited
5 0.6 proprietary unauthori: unauthori[sz]ed (?:copying|reproduction|use|distribution) (?:[^ ]+ ){0,8}(?:prohibited|forbidden)
5 0.6 proprietary part_of_this: no part of this (?:[^ ]+ ){0,4}may be reproduced
5 0.5 proprietary without&permission: without (?:the )?(?:prior )?(?:express )?(?:written )?permission
5 0.6 proprietary licen: end user licen[cs]e agreement
5 0.6 proprietary licen: proprietary licen[cs]e
5 0.6 commercial licen: commercial licen[cs]e(?: agreement)?
5 0.6 evaluation licen: (?:evaluation|trial) licen[cs]e(?: agreement)?
5 0.6 non-commercial commercial&only|licen: for non ?commercial (?:use|purposes?) only
5 0.6 non-commercial commercial&only|licen: non ?commercial licen[cs]e
5 0.6 research for_research: for research (?:use|purposes?) only
5 0.6 freeware freeware: freeware(?: licen[cs]e)?
5 0.6 shareware shareware: shareware(?: licen[cs]e)?
5 0.5 open-source licen: open source licen[cs]ed?
5 0.5 copyleft copyleft: copyleft
5 0.6 warranty without_warranty: provided as is without warranty of any kind
9 0.3 unknown licen: licen[cs]ed under
9 0.3 unknown licen: under (?:the )?terms of (?:the|this) licen[cs]e
9 0.3 unknown licen: see (?:the )?licen[cs]e(?: file)? for (?:more )?(?:details|information)
"""


def rules(text: str = SIGNATURES) -> list[Rule]:
    """The rules of a text as SIGNATURES, in its order."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        head, pattern = line.split(": ", 1)
        priority, confidence, label, keywords = head.split(" ")
        out.append(Rule(label, keywords, pattern, int(priority), float(confidence)))
    return out
