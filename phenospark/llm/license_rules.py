"""Signatures of licenses, in order. One line each: priority, label, keywords, regular expression.

Expressions run over lower-case words joined by single blanks ("Apache-2.0" reads "apache 2 0") and match whole words. A rule is
tried only if the text holds all of its keywords. Priorities: 1 tags and wording found in one license only, 2 grants ("licensed
under ..."), 3 titles with a version, 4 titles, 5 addresses and files, 6 hints.
"""

RULES = r"""
1 mit identifier spdx license identifier mit
1 mit permission,charge permission is hereby granted free of charge to any person obtaining a copy of this software
1 mit sublicense,merge to use copy modify merge publish distribute sublicense and or sell copies of the software
2 mit under (licensed|released|distributed|available|provided) under the (terms of the )?(mit|expat)( x11)? licen[cs]e
2 mit under,mit under the mit license
3 mit mit,x11 mit x11( licen[cs]e)?
4 mit mit,license (the )?mit license( mit)?
4 mit expat,license expat license
5 mit opensource,mit opensource org licenses? mit( license)?
6 mit mit,license license mit
1 mit-0 identifier,0 spdx license identifier mit 0
3 mit-0 mit,attribution mit no attribution( license)?
5 mit-0 mit,0 licenses mit 0
1 apache-2 identifier,apache spdx license identifier apache 2 0
1 apache-2 compliance,apache licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
1 apache-2 applicable,agreed unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
2 apache-2 under,apache (licensed|released|distributed|available) under (the )?(terms of the )?apache (software )?(license )?(version |v )?(v2|2)( 0)?( license)?
3 apache-2 apache,version apache license version 2( 0)?
3 apache-2 apache,license apache (software )?license v?2( 0)?
3 apache-2 apache apache 2 0( licen[cs]e)?
3 apache-2 asl asl 2 0
5 apache-2 apache,org (www )?apache org licenses license 2 0( txt| html)?
5 apache-2 apache,opensource opensource org licenses apache 2 0
1 apache-1.1 identifier,apache spdx license identifier apache 1 1
3 apache-1.1 apache,1 apache (software )?license (version |v )?1 1
5 apache-1.1 apache,org (www )?apache org licenses license 1 1
1 apache-1.0 identifier,apache spdx license identifier apache 1 0
3 apache-1.0 apache,1 apache (software )?license (version |v )?1 0
4 apache apache,license (the )?apache (software )?license
1 bsd-2-clause identifier,bsd spdx license identifier bsd 2 clause
3 bsd-2-clause bsd,clause bsd 2 clause( simplified| freebsd)?( license)?
3 bsd-2-clause bsd,simplified simplified bsd( license)?
3 bsd-2-clause freebsd,license freebsd license
3 bsd-2-clause bsd,clause (two|2) clause bsd( license)?
5 bsd-2-clause opensource,bsd opensource org licenses? bsd (2 clause|license php)
1 bsd-3-clause identifier,bsd spdx license identifier bsd 3 clause
1 bsd-3-clause endorse,contributors neither the names? of (\S+ ){1,12}nor the names of (its|their|his|other)?( )?contributors may be used to endorse or promote products
3 bsd-3-clause bsd,clause bsd 3 clause( new| revised)?( license)?
3 bsd-3-clause bsd (new|revised|modified) bsd( license)?
3 bsd-3-clause bsd,clause (three|3) clause bsd( license)?
5 bsd-3-clause opensource,bsd opensource org licenses? bsd 3 clause
1 bsd-4-clause identifier,bsd spdx license identifier bsd 4 clause
1 bsd-4-clause advertising,acknowledgement all advertising materials mentioning features or use of this software must display the following acknowledgement
3 bsd-4-clause bsd,clause (bsd 4 clause|(four|4) clause bsd)( license)?
3 bsd-4-clause bsd,original original bsd( license)?
1 bsd-0-clause identifier,0bsd spdx license identifier 0bsd
3 bsd-0-clause bsd,clause (bsd 0 clause|zero clause bsd)( license)?
1 bsd redistribution,source redistribution and use in source and binary forms with or without modification are permitted
2 bsd under,bsd (licensed|released|distributed|available) under (the |a )?(terms of the )?bsd( style)? licen[cs]e
4 bsd bsd bsd( style)? licen[cs]e
1 isc identifier,isc spdx license identifier isc
1 isc permission,fee permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 isc under,isc (licensed|released|distributed) under (the )?(terms of the )?isc licen[cs]e
4 isc isc isc licen[cs]e
5 isc opensource,isc opensource org licenses? isc
1 gpl-3.0-or-later identifier,gpl spdx license identifier gpl 3 0 or later
1 gpl-3.0-only identifier,gpl spdx license identifier gpl 3 0 only
1 gpl-3.0-or-later redistribute,foundation redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or (at your option )?any later version
2 gpl-3.0 under,gnu (licensed|released|distributed|available) under (the )?(terms of the )?gnu (general public license|gpl)( gpl)? (version |v )?v?3( 0)?
3 gpl-3.0-or-later gnu,later gnu general public license (version |v )?3( 0)? or (any )?later( version)?
3 gpl-3.0 gnu,general gnu general public license( gpl)? (version |v )?v?3( 0)?
3 gpl-3.0 gpl (gnu )?gpl (version |v )?3( 0)?
3 gpl-3.0 gplv3 gplv3
3 gpl-3.0 gplv3 gnu gplv3
5 gpl-3.0 gnu,gpl gnu org licenses? gpl 3 0( en)?( html| txt)?
1 gpl-2.0-or-later identifier,gpl spdx license identifier gpl 2 0 or later
1 gpl-2.0-only identifier,gpl spdx license identifier gpl 2 0 only
1 gpl-2.0-or-later redistribute,foundation redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or (at your option )?any later version
2 gpl-2.0 under,gnu (licensed|released|distributed|available) under (the )?(terms of the )?gnu (general public license|gpl)( gpl)? (version |v )?v?2( 0)?
3 gpl-2.0-or-later gnu,later gnu general public license (version |v )?2( 0)? or (any )?later( version)?
3 gpl-2.0 gnu,general gnu general public license( gpl)? (version |v )?v?2( 0)?
3 gpl-2.0 gpl (gnu )?gpl (version |v )?2( 0)?
3 gpl-2.0 gplv2 gplv2
3 gpl-2.0-classpath classpath,exception gpl 2 0 with classpath exception
1 gpl-2.0-classpath statically,linking linking this library statically or dynamically with other modules is making a combined work
5 gpl-2.0 gnu,gpl gnu org licenses? (old licenses )?gpl 2 0( en)?( html| txt)?
1 gpl-1.0 identifier,gpl spdx license identifier gpl 1 0( only| or later)?
3 gpl-1.0 gnu,general gnu general public license (version |v )?1( 0)?
1 gpl received,gnu you should have received a copy of the gnu general public license along with
1 gpl warranty,gnu without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
2 gpl under,gnu under the (terms of the )?gnu (general public license|gpl)
4 gpl gnu,general (the )?gnu general public license
4 gpl gnu,gpl gnu gpl
5 gpl gnu,gpl gnu org (copyleft|licenses) gpl( html| txt)?
1 lgpl-3.0-or-later identifier,lgpl spdx license identifier lgpl 3 0 or later
1 lgpl-3.0-only identifier,lgpl spdx license identifier lgpl 3 0 only
3 lgpl-3.0 gnu,lesser gnu lesser general public license (version |v )?v?3( 0)?
3 lgpl-3.0 lgpl (gnu )?lgpl (version |v )?3( 0)?
3 lgpl-3.0 lgplv3 lgplv3
5 lgpl-3.0 gnu,lgpl gnu org licenses? lgpl 3 0
1 lgpl-2.1-or-later identifier,lgpl spdx license identifier lgpl 2 1 or later
1 lgpl-2.1-only identifier,lgpl spdx license identifier lgpl 2 1 only
1 lgpl-2.1-or-later terms,lesser modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license
3 lgpl-2.1 gnu,lesser gnu lesser general public license (version |v )?v?2 1
3 lgpl-2.1 lgpl (gnu )?lgpl (version |v )?2 1
3 lgpl-2.1 lgplv2 lgplv2 1
5 lgpl-2.1 gnu,lgpl gnu org licenses? (old licenses )?lgpl 2 1
1 lgpl-2.0 identifier,lgpl spdx license identifier lgpl 2 0( only| or later)?
3 lgpl-2.0 gnu,library gnu library general public license (version |v )?2( 0)?
2 lgpl under,lesser under the (terms of the )?gnu lesser general public license
4 lgpl gnu,lesser (the )?gnu lesser general public license
4 lgpl gnu,library (the )?gnu library general public license
4 lgpl gnu,lgpl gnu lgpl
1 agpl-3.0-or-later identifier,agpl spdx license identifier agpl 3 0 or later
1 agpl-3.0-only identifier,agpl spdx license identifier agpl 3 0 only
1 agpl-3.0-or-later terms,affero modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license
3 agpl-3.0 gnu,affero gnu affero general public license (version |v )?v?3( 0)?
3 agpl-3.0 agpl (gnu )?agpl (version |v )?3( 0)?
3 agpl-3.0 agplv3 agplv3
5 agpl-3.0 gnu,agpl gnu org licenses? agpl 3 0
2 agpl under,affero under the (terms of the )?(gnu )?affero general public license
4 agpl affero (gnu )?affero general public license
1 gfdl-1.3 identifier,gfdl spdx license identifier gfdl 1 3( only| or later)?
1 gfdl-1.2 identifier,gfdl spdx license identifier gfdl 1 2( only| or later)?
1 gfdl cover,invariant with no invariant sections no front cover texts and no back cover texts
3 gfdl-1.3 gnu,documentation gnu free documentation license (version |v )?1 3
3 gfdl-1.2 gnu,documentation gnu free documentation license (version |v )?1 2
4 gfdl gnu,documentation (the )?gnu free documentation license
5 gfdl gnu,fdl gnu org (copyleft|licenses) fdl( html)?
1 mpl-2.0 identifier,mpl spdx license identifier mpl 2 0
1 mpl-2.0 mozilla,subject this source code form is subject to the terms of the mozilla public license v 2 0
2 mpl-2.0 under,mozilla (licensed|released|distributed) under (the )?(terms of the )?mozilla public license (version |v )?2( 0)?
3 mpl-2.0 mozilla mozilla public license (version |v )?2( 0)?
3 mpl-2.0 mpl mpl (version |v )?2 0
5 mpl-2.0 mozilla,mpl mozilla org (en us )?mpl 2 0
1 mpl-1.1 identifier,mpl spdx license identifier mpl 1 1
1 mpl-1.1 mozilla,contents the contents of this file are subject to the mozilla public license version 1 1
3 mpl-1.1 mozilla mozilla public license (version |v )?1 1
3 mpl-1.0 mozilla mozilla public license (version |v )?1 0
4 mpl mozilla,license (the )?mozilla public license
1 epl-2.0 identifier,epl spdx license identifier epl 2 0
1 epl-2.0 eclipse,available made available under the terms of the eclipse public license (version |v )?2 0
3 epl-2.0 eclipse eclipse public license (version |v )?2 0
5 epl-2.0 eclipse,epl eclipse org legal epl 2 0
1 epl-1.0 identifier,epl spdx license identifier epl 1 0
1 epl-1.0 eclipse,available made available under the terms of the eclipse public license (version |v )?1 0
3 epl-1.0 eclipse eclipse public license (version |v )?1 0
5 epl-1.0 eclipse,epl eclipse org legal epl v10
4 epl eclipse,license (the )?eclipse public license
1 cddl-1.0 identifier,cddl spdx license identifier cddl 1 0
3 cddl-1.0 development,distribution common development and distribution license( cddl)? (version |v )?1 0
3 cddl-1.1 development,distribution common development and distribution license( cddl)? (version |v )?1 1
4 cddl development,distribution common development and distribution license
1 eupl-1.2 identifier,eupl spdx license identifier eupl 1 2
3 eupl-1.2 european,union european union public licen[cs]e( eupl)? (version |v )?1 2
3 eupl-1.1 european,union european union public licen[cs]e( eupl)? (version |v )?1 1
4 eupl european,union european union public licen[cs]e
1 ms-pl identifier,pl spdx license identifier ms pl
4 ms-pl microsoft,public microsoft public license( ms pl)?
4 ms-rl microsoft,reciprocal microsoft reciprocal license( ms rl)?
1 artistic-2.0 identifier,artistic spdx license identifier artistic 2 0
3 artistic-2.0 artistic,license (the )?artistic license (version |v )?2( 0)?
3 artistic-1.0 artistic,license (the )?artistic license (version |v )?1( 0)?
1 artistic perl,same same terms as perl( 5)? itself
4 artistic artistic,license (the )?artistic license
1 bsl-1.0 identifier,bsl spdx license identifier bsl 1 0
3 bsl-1.0 boost,software distributed under the boost software license version 1 0
3 bsl-1.0 boost,software boost software license (version |v )?1 0
4 bsl-1.0 boost,software (the )?boost software license
5 bsl-1.0 boost,license boost org license 1 0 txt
1 busl-1.1 identifier,busl spdx license identifier busl 1 1
3 busl-1.1 business,source business source license (version |v )?1 1
4 busl business,source,license (the )?business source license
1 sspl-1.0 identifier,sspl spdx license identifier sspl 1 0
4 sspl-1.0 server,side server side public license( version 1| v1| sspl)?
1 elastic-2.0 identifier,elastic spdx license identifier elastic 2 0
3 elastic-2.0 elastic,license elastic license (version |v )?2( 0)?
4 elastic elastic,license (the )?elastic license
1 zlib identifier,zlib spdx license identifier zlib
1 zlib express,arising provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
4 zlib zlib,license (the )?zlib( libpng)? license
1 unlicense identifier,unlicense spdx license identifier unlicense
1 unlicense unencumbered this is free and unencumbered software released into the public domain
4 unlicense unlicense (the )?unlicense
5 unlicense unlicense,org unlicense org
1 wtfpl identifier,wtfpl spdx license identifier wtfpl
4 wtfpl fuck,want do what the fuck you want to public license
4 wtfpl wtfpl (the )?wtfpl
1 cc0-1.0 identifier,cc0 spdx license identifier cc0 1 0
1 cc0-1.0 dedicated,waiving dedicated the work to the public domain by waiving all of his or her rights
3 cc0-1.0 cc0 cc0 1 0( universal)?
3 cc0-1.0 creative,zero creative commons zero( v1 0)?( universal)?
4 cc0-1.0 cc0 cc0
5 cc0-1.0 creativecommons,zero creativecommons org publicdomain zero 1 0
1 cc-by-4.0 identifier,cc spdx license identifier cc by 4 0
3 cc-by-4.0 creative,attribution creative commons attribution 4 0( international)?( license| public license)?
3 cc-by-4.0 cc,by cc by 4 0
5 cc-by-4.0 creativecommons,by creativecommons org licenses by 4 0
1 cc-by-3.0 identifier,cc spdx license identifier cc by 3 0
3 cc-by-3.0 creative,attribution creative commons attribution 3 0( unported)?( license)?
3 cc-by-3.0 cc,by cc by 3 0
5 cc-by-3.0 creativecommons,by creativecommons org licenses by 3 0
3 cc-by-2.5 cc,by cc by 2 5
3 cc-by-2.0 cc,by cc by 2 0
1 cc-by-sa-4.0 identifier,sa spdx license identifier cc by sa 4 0
3 cc-by-sa-4.0 creative,attribution creative commons attribution share ?alike 4 0( international)?( license| public license)?
3 cc-by-sa-4.0 cc,sa cc by sa 4 0
5 cc-by-sa-4.0 creativecommons,sa creativecommons org licenses by sa 4 0
3 cc-by-sa-3.0 creative,attribution creative commons attribution share ?alike 3 0( unported)?( license)?
3 cc-by-sa-3.0 cc,sa cc by sa 3 0
5 cc-by-sa-3.0 creativecommons,sa creativecommons org licenses by sa 3 0
4 cc-by-sa creative,attribution creative commons attribution share ?alike( license)?
4 cc-by-sa creative,share creative commons attribution share alike( license)?
4 cc-by-sa cc,sa cc by sa
3 cc-by-nc-4.0 creative,attribution creative commons attribution non ?commercial 4 0( international)?( license)?
3 cc-by-nc-4.0 cc,nc cc by nc 4 0
5 cc-by-nc-4.0 creativecommons,nc creativecommons org licenses by nc 4 0
4 cc-by-nc creative,attribution creative commons attribution non ?commercial( license)?
4 cc-by-nc cc,nc cc by nc
3 cc-by-nc-sa-4.0 cc,nc,sa cc by nc sa 4 0
5 cc-by-nc-sa-4.0 creativecommons,nc,sa creativecommons org licenses by nc sa 4 0
3 cc-by-nc-sa-3.0 cc,nc,sa cc by nc sa 3 0
4 cc-by-nc-sa creative,attribution creative commons attribution non ?commercial share ?alike( \d \d)?( international)?( license)?
4 cc-by-nc-sa cc,nc,sa cc by nc sa
3 cc-by-nc-nd-4.0 cc,nc,nd cc by nc nd 4 0
5 cc-by-nc-nd-4.0 creativecommons,nc,nd creativecommons org licenses by nc nd 4 0
4 cc-by-nc-nd creative,attribution creative commons attribution non ?commercial no ?deriv(ative)?s( \d \d)?( international)?( license)?
4 cc-by-nc-nd cc,nc,nd cc by nc nd
3 cc-by-nd-4.0 cc,nd cc by nd 4 0
4 cc-by-nd creative,attribution creative commons attribution no ?deriv(ative)?s( \d \d)?( international)?( license)?
4 cc-by-nd cc,nd cc by nd
4 cc-by creative,attribution creative commons attribution( license)?
4 cc-by cc,by cc by
6 cc creative,commons (a )?creative commons licen[cs]e
1 odbl-1.0 identifier,odbl spdx license identifier odbl 1 0
4 odbl-1.0 database,open open (data commons )?(open )?database license( odbl)?( v?1 0)?
4 odc-by data,attribution open data commons attribution license
4 pddl-1.0 dedication,domain (open data commons )?public domain dedication and licen[cs]e
1 ofl-1.1 identifier,ofl spdx license identifier ofl 1 1
3 ofl-1.1 sil,font sil open font license (version |v )?1 1
4 ofl-1.1 font,open (sil )?open font license
5 ofl-1.1 scripts,ofl scripts sil org ofl
1 python-2.0 identifier,python spdx license identifier python 2 0
4 psf-2.0 python,foundation python software foundation license( version 2| v2)?
4 php-3.01 php,license php license (version |v )?3 01
4 php php,license (the )?php license
4 ruby ruby,license (the )?ruby license
4 openssl openssl,license (the )?openssl license
1 curl identifier,curl spdx license identifier curl
4 ncsa ncsa,illinois university of illinois ncsa open source license
1 ncsa identifier,ncsa spdx license identifier ncsa
1 postgresql identifier,postgresql spdx license identifier postgresql
4 postgresql postgresql (the )?postgresql licen[cs]e
1 afl-3.0 identifier,afl spdx license identifier afl 3 0
4 afl-3.0 academic,free academic free license( version 3 0| v 3 0)?
1 osl-3.0 identifier,osl spdx license identifier osl 3 0
4 osl-3.0 open,software,3 open software license (version |v )?3 0
1 upl-1.0 identifier,upl spdx license identifier upl 1 0
4 upl-1.0 universal,permissive universal permissive license( version 1 0| v 1 0)?
1 ecl-2.0 identifier,ecl spdx license identifier ecl 2 0
4 ecl-2.0 educational,community educational community license( version 2 0| v 2 0)?
1 mulan-psl-2.0 identifier,mulanpsl spdx license identifier mulanpsl 2 0
4 mulan-psl-2.0 mulan,permissive mulan permissive software license( version 2| v2)?
1 cecill-2.1 identifier,cecill spdx license identifier cecill 2 1
4 cecill cecill (the )?cecill( b| c)?( free software)? licen[cs]e
1 zpl-2.1 identifier,zpl spdx license identifier zpl 2 1
4 zpl-2.1 zope,public zope public license( version 2 1| v 2 1)?
4 ipl-1.0 ibm,public ibm public license( version 1 0| v1 0)?
4 cpl-1.0 common,public,license common public license( version 1 0| v1 0)?
4 qpl-1.0 q,public,license q public license
4 vim vim,license (the )?vim license
4 llama-2 llama,community llama 2 community license( agreement)?
4 llama-3 llama,community llama 3( \d)? community license( agreement)?
4 openrail-m openrail (creativeml |bigscience )?(bloom )?openrail( m| plus plus m)?( license)?
4 gemma gemma,terms gemma terms of use
1 public-domain released,domain (has been |is )?(hereby )?released (in)?to the public domain
2 public-domain placed,domain placed in the public domain
4 public-domain dedicated,domain dedicated to the public domain
5 public-domain creativecommons,mark creativecommons org publicdomain mark 1 0
1 proprietary confidential,proprietary (this \S+ (is|contains) )?(proprietary and confidential|confidential and proprietary)
1 proprietary part,permission no part of this (\S+ ){1,3}may be (reproduced|copied|distributed) (\S+ ){0,14}without (the )?(prior |express )?(written )?permission
2 proprietary strictly,prohibited unauthori[sz]ed (copying|use|reproduction|distribution) (\S+ ){0,10}(is )?strictly prohibited
4 proprietary reserved,rights all rights reserved
6 proprietary eula end user licen[cs]e agreement eula
4 proprietary user,agreement end user licen[cs]e agreement
6 unknown see,for see (the )?licen[cs]e (file )?for (the )?(details|terms|more information)
6 unknown license,file see (the )?license( txt| md)? file
"""
