"""What the licence scanner knows: names of licences, forms of notices, and paragraphs of licence texts.

Notices are made by rule from forms and names. Fixed values: names and wording are the licences' own.
"""

#: Names by family, the longest forms first; a version that a family doesn't fix stands after the name in a text.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT license", "Expat License", "MIT/X11 License"],
    "MIT-0": ["MIT No Attribution License", "MIT-0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0", "ASL 2.0", "Apache Software License, Version 2.0"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1", "Apache-1.1"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPLv2.1", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-or-later", "LGPL-3.0-or-later"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero GPL", "GNU AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "GFDL": ["GNU Free Documentation License", "GNU FDL", "GFDL-1.3"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "3-Clause BSD License", "2-Clause BSD License", "New BSD License", "Modified BSD License", "Simplified BSD License", "BSD License", "BSD-3-Clause", "BSD-2-Clause", "BSD-style license"],
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License", "0BSD"],
    "ISC": ["ISC License"],
    "MPL": ["Mozilla Public License", "MPL 2.0", "MPL-2.0", "MPL-1.1"],
    "EPL": ["Eclipse Public License", "EPL 2.0", "EPL-2.0", "EPL-1.0"],
    "CDDL": ["Common Development and Distribution License", "CDDL-1.0", "CDDL-1.1"],
    "CPL": ["Common Public License", "CPL-1.0"],
    "EUPL": ["European Union Public Licence", "European Union Public License", "EUPL-1.2", "EUPL 1.2"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "CC-BY-3.0"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 3.0 Unported License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "CC-BY-SA-3.0"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC-4.0"],
    "CC-BY-ND": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivs License", "CC BY-ND 4.0", "CC BY-ND 3.0", "CC-BY-ND-4.0"],
    "CC-BY-NC-SA": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike License", "CC BY-NC-SA 4.0", "CC BY-NC-SA 3.0", "CC-BY-NC-SA-4.0"],
    "CC-BY-NC-ND": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Creative Commons Attribution-NonCommercial-NoDerivs License", "CC BY-NC-ND 4.0", "CC BY-NC-ND 3.0", "CC-BY-NC-ND-4.0"],
    "CC0": ["Creative Commons Zero", "Creative Commons CC0 License", "CC0 1.0 Universal", "CC0 1.0", "CC0-1.0"],
    "Unlicense": ["Unlicense"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "BSL-1.0": ["Boost Software License", "BSL-1.0"],
    "Artistic": ["Artistic License", "Artistic-2.0", "Perl Artistic License"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "PostgreSQL": ["PostgreSQL License"],
    "PSF": ["Python Software Foundation License", "PSF License", "PSF-2.0"],
    "OFL": ["SIL Open Font License", "OFL-1.1"],
    "MS-PL": ["Microsoft Public License", "MS-PL"],
}
#: Names of licences that belong to no family here: their notices are fitted on as unknown.
OTHER_NAMES = ["Acme Commercial License", "City Trading License", "Beerware License", "Example Corp Source License 1.0", "Open Data License 1.0", "Vendor Evaluation License, Version 3", "Business Source License 1.1", "Server Side Public License", "Northwind Public License, Version 2.0", "standard liquor license", "Public License", "Software License"]
#: How notices say it.
FORMS = [
    "Licensed under the {}.", "Released under the {}.", "This work is licensed under a {}.", "This project is licensed under the terms of the {}.",
    "Distributed under the {}. See LICENSE for details.", "This file is subject to the terms and conditions of the {}.", "You may use this software under the {}.",
    "SPDX-License-Identifier: {}", "License: {}", "{}, version 2.0", "Licensed under the {}, version 3.", "Copyright Example Authors. Use of this source code is governed by a {} that can be found in the LICENSE file.", "All source code is made available under the {} unless noted otherwise.",
]
#: Words after which a name states a licence.
GRANTS = {"licensed", "licenced", "released", "distributed", "available", "published", "provided", "redistribute", "subject", "terms", "use", "used", "spdxlicenseidentifier", "license", "licence", "governed", "covered", "dedicated", "waived", "offered", "shared", "conditions"}
#: Words that turn a notice into its contrary.
DENIALS = {"not", "never", "isnt", "arent", "wasnt", "neither", "nor", "no", "cannot", "without", "unlike", "incompatible", "formerly", "instead"}
#: Paragraphs of licences and of the headers that they ask for.
TEXTS: dict[str, list[str]] = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "GFDL": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CDDL": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License."],
    "CC-BY": ["You are free to share, copy and redistribute the material in any medium or format, and to adapt, remix, transform, and build upon the material for any purpose, even commercially, under the following terms: Attribution"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "OFL": ["This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at"],
    "Artistic": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."],
}
#: Sentences near licences in wording that state none.
TALK = [
    "The driver had to show a license at the border.", "She works under a license from the city.", "A new version of the public transport plan is free of charge.",
    "The license of the restaurant was renewed under the general terms.", "This work is under way and may not be used for publication.", "Permission to enter the park was granted by the office.",
    "All rights reserved.", "The committee released version 3 of the report to the public.", "He attended MIT before he joined the foundation.", "Apache helicopters were seen over the valley.",
    "No license is granted by implication.", "Contact us for licensing terms.", "The eclipse was seen by the general public.", "Redistribution of wealth was the subject of the debate.",
    "Software licenses cost the company a fortune last year.", "The Mozilla Foundation published its yearly report.", "Boost your career with our software course.", "Python is a language and also a snake.",
    "The artistic director provided the terms of the contract.", "Permission to copy the key was denied without a fee.", "Use of the material is subject to the rules of the house.", "The conditions of the road were poor.",
]
