"""Wordings of licence families, those that the classifier learns from and those that confirm what it says."""


#: Family to the wordings that a paragraph is compared with. The classifier does not learn from them; its thresholds are set on them.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "This work is licensed under the Apache License, Version 2.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU General Public License version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under the GPL.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "public-domain": [
        "Released into the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
        "Proprietary and confidential. No part may be reproduced without prior written permission.",
    ],
}

#: Family to other wordings, which the classifier learns from.
NOTICES: dict[str, list[str]] = {
    "mit": [
        "This library is distributed under the MIT licence; see the file LICENSE for its text.",
        "The code in this repository is MIT licensed.",
        "You may use this module under the terms of the MIT License.",
        "Permission is granted, free of charge, to any person who obtains a copy of this software and its documentation files to deal in the Software without restriction, and to permit persons to whom the Software is furnished to do so.",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and sell copies of the Software, subject to the following conditions",
        "License: MIT",
        "SPDX-License-Identifier: MIT-0",
        "Released under MIT.",
    ],
    "apache-2.0": [
        "This module is made available under the Apache 2.0 license.",
        "Unless you comply with the Apache License, Version 2.0, you may not use this file.",
        "You may obtain a copy of the Apache License at www.apache.org licenses LICENSE-2.0",
        "The project uses the Apache License, Version 2.0, as its license.",
        "License: Apache-2.0",
        "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception",
        "Distributed under the terms of the Apache License 2.0.",
    ],
    "gpl": [
        "This package may be redistributed under the terms of the GNU General Public License, version 2 or later, as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "The program is covered by the GNU GPL, version 3 or any later version.",
        "It is free software under the GNU General Public License; either version 2 of the License, or any later version.",
        "License: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GPL version 3.",
    ],
    "lgpl": [
        "You may redistribute the library under the GNU Lesser General Public License, version 3 or later.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "This library is covered by the GNU LGPL, version 2.1.",
        "The library may be modified under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "License: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "Released under the LGPL.",
    ],
    "agpl": [
        "The server is covered by the GNU Affero General Public License, version 3 or later.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "You may redistribute it under the terms of the GNU AGPL version 3.",
        "It may be modified under the GNU Affero General Public License as published by the Free Software Foundation.",
        "License: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Released under the AGPL.",
    ],
    "bsd": [
        "This driver is distributed under a BSD style license.",
        "You may use the code under the terms of the 2-clause BSD License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistribution in source and binary forms, with or without modification, is permitted if the following conditions are met.",
        "Redistributions in binary form must reproduce the above copyright notice in the documentation and other materials provided with the distribution.",
        "License: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "The sources are available under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, you can obtain one at mozilla.org MPL 2.0.",
        "This file is subject to the Mozilla Public License, v. 2.0.",
        "Covered by the MPL, version 2.0.",
        "License: MPL-2.0",
        "SPDX-License-Identifier: MPL-2.0-no-copyleft-exception",
    ],
    "cc-by": [
        "The text is available under a Creative Commons Attribution 4.0 license.",
        "You may share these pictures under CC BY 4.0 if you give attribution.",
        "Published under the Creative Commons Attribution License 3.0.",
        "The photographs are licensed under CC-BY 3.0.",
        "License: CC-BY-4.0",
        "SPDX-License-Identifier: CC-BY-3.0",
    ],
    "cc-by-sa": [
        "The text is available under the Creative Commons Attribution-ShareAlike license.",
        "You may share these pictures under CC BY-SA 4.0, with attribution and share alike.",
        "Published under the Creative Commons Attribution Share Alike License 3.0.",
        "Articles are licensed under CC-BY-SA 3.0.",
        "License: CC-BY-SA-4.0",
        "SPDX-License-Identifier: CC-BY-SA-3.0",
    ],
    "cc-by-nc": [
        "The text is available under a Creative Commons Attribution-NonCommercial license.",
        "You may share these pictures under CC BY-NC 4.0, for noncommercial use with attribution.",
        "Published under the Creative Commons Attribution Non Commercial License 3.0.",
        "Lessons are licensed under CC-BY-NC 3.0.",
        "License: CC-BY-NC-4.0",
        "SPDX-License-Identifier: CC-BY-NC-3.0",
    ],
    "public-domain": [
        "The author has placed this work in the public domain.",
        "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this unencumbered software released into the public domain.",
        "This file is in the public domain.",
        "License: CC0-1.0",
        "SPDX-License-Identifier: CC0-1.0 OR Unlicense",
        "Free and unencumbered, under the Unlicense.",
    ],
    "proprietary": [
        "Copyright, the company. All rights are reserved.",
        "This document is confidential and proprietary, and may not be reproduced or copied without written permission.",
        "Unauthorized copying or distribution of this material is strictly prohibited.",
        "No part of this publication may be reproduced in any form without the prior permission of the publisher. All rights reserved.",
        "Proprietary software. All rights reserved by the owner.",
        "All rights reserved by the author and the publisher.",
        "Copyright by the author, all rights reserved worldwide.",
        "All rights reserved, including those of translation.",
        "Some rights may be licensed, and all other rights reserved.",
        "Confidential. Not to be copied without written permission.",
    ],
}

#: Wordings of licences of no listed family.
UNLISTED: list[str] = [
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "You may distribute this package under the terms of the Artistic License 2.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "This font software is licensed under the SIL Open Font License, version 1.1.",
    "Distributed under the Boost Software License, version 1.0.",
    "Use of this software is governed by the Business Source License included in the file LICENSE.",
    "This product is licensed, not sold, and your use of it is subject to the end user license agreement.",
    "You are granted a nonexclusive, nontransferable license to install and use the software on one computer.",
    "Licensed under the Educational Community License, version 2.0.",
    "This work is made available under the terms of the Open Database License.",
    "Licensed under the Academic Free License version 3.0.",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Zlib",
    "License: ISC",
    "Released under the Python Software Foundation License.",
    "Released under the Microsoft Public License.",
    "Licensed under the PostgreSQL License.",
    "You may use, copy and modify this work under the terms of the Community License Agreement.",
]

#: Paragraphs that are no licence.
OTHER: list[str] = [
    "She lost her driver's license on the way to the bank and had to apply for a new one.",
    "The museum is open to the public from nine to five, and the first hour is free of charge.",
    "He studied at MIT before he moved to the coast with his family.",
    "An Apache helicopter was seen over the valley in the morning.",
    "The creative team met in the commons to plan the general release of the new version.",
    "Please use the form on the following page and keep a copy of it.",
    "The city granted a license to the restaurant after the second hearing.",
    "Version 3 of the work is better than version 2, and it is free.",
    "The council met in public and the terms were reserved for a later day.",
    "Source and binary stars were the subject of the first part of the talk.",
    "All of the rights to the song were sold in the year of its release.",
    "A permission slip is needed for the trip, without restriction of age.",
    "The software was slow and the documentation had not been written.",
    "No domain of science is without its share of errors.",
    "A wild gnu crossed the river with the rest of the herd.",
    "The attribution of the painting to the master was disputed for years.",
    "A copy of the letter was found in the file of the court, with a note by the clerk.",
    "The program begins at eight, and it is followed by a talk on the terms of the treaty.",
    "You can use this path if the other one is closed, but you should not go there at night.",
    "They were permitted to distribute food and water to persons in the camp without delay.",
    "The foundation was published in the same year as the library, and both are free to visit.",
    "Any person who has seen the file is asked to call the office at this number.",
    "The conditions in the source of the river have changed, and the following list gives the notice of each station.",
    "It may not be used to work on the above, subject to the rules of the house.",
    "The author of the book has a copyright claim, which the court will hear in spring.",
    "He obtained a general permit and can now sell, publish and modify what he has made.",
    "By the terms of the contract the company had to provide the materials and the documentation.",
    "The project was made available to the community under the direction of the council.",
    "The use of common land is governed by an old agreement, and everyone is granted the same part.",
    "We released the birds into the wild under a clear sky and went home.",
    "The mozilla was a dragon in a story that the children wrote together.",
    "A public hearing on the new school will be held in the hall on the first of May.",
    "Her rights as a member were reserved until the general meeting in autumn.",
    "The affair of the lesser houses is described in the second volume, with notes.",
    "Without prior notice the part was closed, and no permission was given to enter.",
    "Redistribution of land was the aim of the law, in one form or another.",
    "The version that was published in the paper is confidential no longer.",
    "In no event should a child be left alone near the water, or in any boat.",
    "The warranty of the car ends after three years, or sooner if it is sold.",
    "An alike view was held by most of the authors, who share the same school.",
    "The software of the machine has to be written anew for each purpose.",
    "You should have received the second letter by now, along with the map.",
    "If a later train is late, either wait at the station or take the bus.",
    "They unlicensed the tavern after the fire and its owner left the town.",
    "The identifier of the sample is on the label, and the list is in the file.",
    "The apache and the mohawk are among the peoples that the museum shows.",
    "It is strictly a matter of form, and the document may be copied by hand.",
    "All of us are free to read, to write and to say what we have seen.",
    "The commercial use of the river began with the mills, for which no fee was due.",
    "The international order was accompanied by a union of the customs offices.",
    "You may go now, or you may stay with us, but all of you must be here by the following day.",
    "Any of these may be made at home, provided that you have the time and the material.",
    "All of it must be done under the open sky and without a break, or it has to be done again.",
    "This is only a part of what its author has made, and all of his later work was subject to doubt.",
    "The program was available to any member of the community who had the code of the door.",
    "You must be free of any debt, or they will not share the house with you.",
    "Without a permission to build, any work on this site is subject to the conditions above.",
    "A later version of the story has it that all copies were lost, and that this one is the only source.",
    "The rights of the child are made clear in the following clause, under which all may be heard.",
    "A general of the army was released this week, under conditions that may not be made public.",
    "The library is open to all members, and any of them may copy the following pages.",
    "They made a copy of the key, which is only available at the station, or so they say.",
    "The open source of the spring may be seen from above, where all of the water is free of salt.",
    "To distribute the following copies, you must be at the gate at nine, or later on the same day.",
    "A program of this kind must be provided by the general hospital, and may be subject to change.",
    "This text and its version in verse must be read in binary time, all under one breath.",
    "The above was reproduced from a later work of the same author, with his permission.",
    "Those who attribute the picture to him must share the doubt that any copy may be his.",
    "Mit der Zeit kam er mit den anderen aus, und mit ihnen ging er an den See.",
    "Sie fuhr mit dem Zug in die Stadt und kam erst am Abend mit der Mutter nach Hause.",
    "Das Haus mit dem roten Dach steht noch, und die Kinder spielen mit dem Hund.",
    "Mit mir kann man reden, mit ihm nicht.",
    "Er sprach mit allen, die mit ihm gekommen waren, und das war gut so.",
    "Wer mit uns geht, der muss mit wenig auskommen und mit viel rechnen.",
    "Sie kam mit. Er blieb, denn mit dem Wagen war etwas nicht in Ordnung.",
    "Der Mann mit Hut und die Frau mit Schirm standen vor der Tür.",
    "Er hat mit einem Freund gesprochen, der mit ihr bekannt ist.",
    "Die Arbeit mit Holz macht ihm Freude, die mit Metall nicht.",
    "Wir fangen mit der Suppe an, dann kommt der Fisch mit Reis.",
    "Und mit einem Mal war es still, nur die Uhr lief mit.",
    "Kommst du mit, oder gehst du mit den anderen in die Schule?",
    "Das hat mit der Sache nichts zu tun, sagte sie mit Nachdruck.",
    "In der Stadt mit den vielen Brücken lebt er nun mit seiner Tochter.",
    "Ein Brief mit Marke lag da, mit der Hand geschrieben und mit Tinte.",
    "La maison sur la colline est libre, et la commune en a fait une bibliothèque.",
    "Le mot de la fin est à lui, sa version des faits aussi.",
    "La casa del autor está en el centro, y su obra es de dominio general en la escuela.",
    "Las noches de junio son claras, y la gente sale a la calle sin prisa.",
    "Il mit son manteau, mit la table et sortit sans dire un mot.",
    "Se ha dicho que la comunidad no es de uno, sino de todos los que viven en ella.",
]

#: Sentences that name a licence, and the names of families and of unlisted licences, from which further wordings are made.
FRAMES: list[str] = [
    "Licensed under {}.",
    "Released under {}.",
    "Distributed under the terms of {}.",
    "This work is licensed under {}.",
    "The code is covered by {}.",
    "You may use it under {}.",
    "The project is available under {}, see the license file.",
    "License: {}",
    "All files are subject to {}, unless it is noted otherwise.",
]
NAMES: dict[str, list[str]] = {
    "mit": ["the MIT License", "the MIT licence", "MIT", "an MIT style license"],
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0", "the Apache Software License", "Apache-2.0"],
    "gpl": ["the GNU General Public License", "the GNU General Public License, version 3", "the GNU General Public License version 2", "the GPL", "the GNU GPL v3", "GPL-3.0", "GPL-3.0-or-later"],
    "lgpl": ["the GNU Lesser General Public License", "the GNU Lesser General Public License, version 2.1", "the LGPL", "LGPL-2.1", "LGPL-2.1-only"],
    "agpl": ["the GNU Affero General Public License", "the GNU Affero General Public License, version 3", "the AGPL", "AGPL-3.0", "AGPL-3.0-only"],
    "bsd": ["the BSD License", "the BSD 3-Clause License", "the 2-clause BSD license", "a BSD license", "BSD-2-Clause"],
    "mpl-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the MPL", "MPL-2.0"],
    "cc-by": ["a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution License", "CC BY 4.0", "CC-BY-3.0"],
    "cc-by-sa": ["a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution ShareAlike License", "CC BY-SA 4.0", "CC-BY-SA-3.0"],
    "cc-by-nc": ["a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution NonCommercial License", "CC BY-NC 4.0", "CC-BY-NC-3.0"],
    "public-domain": ["CC0 1.0 Universal", "the Unlicense", "a public domain dedication", "CC0-1.0"],
    "proprietary": ["a proprietary license, all rights reserved", "a confidential and proprietary agreement"],
}
UNLISTED_NAMES: list[str] = [
    "the Eclipse Public License 2.0", "the Artistic License 2.0", "the European Union Public Licence", "the zlib License", "the ISC License", "the Boost Software License 1.0",
    "the Academic Free License", "the Open Software License 3.0", "the Microsoft Public License", "the Python Software Foundation License", "the Ruby License",
    "the SIL Open Font License 1.1", "the Open Database License", "the Business Source License 1.1", "the PHP License", "the Vim License", "the license in this file", "its own license",
]
