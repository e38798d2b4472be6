"""Wording of public licenses and their notices, in the markup of ``licenses``.

Whole bodies come first: every mandatory word must stand. ``[[ ]]`` is optional, ``{{n}}`` is up to n words of one's own. Names, lists of
contributors and headings that publishers change are regions; everything else is wording.
"""

from __future__ import annotations

_AS_IS = "{{8}} provided by {{24}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{24}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"

TEMPLATES = {
    # whole bodies
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {{6}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{6}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "0bsd": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause": f"{_BSD} this software is {_AS_IS}",
    "bsd-3-clause": f"{_BSD} [[3]] neither the name of {{{{12}}}} nor the names of {{{{6}}}} contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is {_AS_IS}",
    "bsl-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "zlib": "this software is provided as is without any express or implied warranty in no event will {{8}} be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain",
    "wtfpl": "do what the fuck you want to public license terms and conditions for copying distribution and modification 0 you just do what the fuck you want to",
    # headers that publishers put on files
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{12}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-2.0-or-later-header": "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-3.0-or-later-header": "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-2.1-or-later-header": "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "agpl-3.0-or-later-header": "free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    # clauses and one-line notices
    "apache-2.0": "licensed under the apache license [[,]] version 2 0 [[the license]]",
    "apache-header": "you may not use this file except in compliance with the license [[you may obtain a copy of the license at]]",
    "bsd": "redistribution and use in source and binary forms [[with or without modification]] are permitted provided that the following conditions are met",
    "bsd-notice": "under [[the]] [[terms of the]] [[{{1}}]] bsd [[{{2}}]] license",
    "boost-notice": "under the boost software license [[version 1 0]]",
    "isc-notice": "under the isc license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "under the mit license [[and {{4}}]]",
    "unlicense-notice": "released into the public domain",
    "unlicense-name": "under the unlicense",
    "zlib-notice": "under the zlib license",
    "cc-by-4.0": "[[this work is]] licensed under [[a]] [[the]] creative commons attribution 4 0 [[international]] [[public]] license",
    "cc-by-sa-4.0": "licensed under [[a]] [[the]] creative commons attribution [[share alike]] [[sharealike]] 4 0 [[international]] [[public]] license",
    "cc-by-sa": "cc by sa [[{{2}}]]",
    "cc-by-nc": "cc by nc",
    "cc-by-nd": "cc by nd",
    "cc-by-notice": "licensed under [[the]] cc by [[{{1}} license]]",
    "cc0": "[[released]] [[licensed]] under [[the]] cc0",
    "cc0-1.0": "[[the person who associated a work with this deed has]] dedicated {{6}} to the public domain",
    "copyright-notice": "copyright [[c]] {{6}} all rights reserved",
    "gpl-any": "under the [[terms of the]] gnu general public license [[version {{3}}]]",
    "lgpl-any": "under the [[terms of the]] gnu lesser general public license [[version {{3}}]]",
    "agpl-any": "under the [[terms of the]] gnu affero general public license [[version {{3}}]]",
    "gpl-3.0": "gnu general public license [[as published by the free software foundation either]] version 3",
    "gpl-2.0": "gnu general public license [[as published by the free software foundation either]] version 2",
    "lgpl-3.0": "gnu lesser general public license [[as published by the free software foundation either]] version 3",
    "agpl-3.0": "gnu affero general public license [[as published by the free software foundation either]] version 3",
    "mpl-2.0": "mozilla public license [[v]] [[version]] 2 0",
    "warranty-none": "the software is provided as is without warranty of any kind [[express or implied]]",
}
