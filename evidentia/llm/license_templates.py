"""Wording by which licence families are known: grant paragraphs and the notices that name them."""

# Public licence wording.
FAMILIES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Distributed under the MIT License. See LICENSE for more information.", "MIT License", "This software is provided under the MIT licence, free of charge.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "This work is made available under the Apache 2.0 license.", "Apache License", "Version 2.0 of the Apache License governs the use of this file.", "Licensed under Apache 2.0.",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GNU GPL v2.", "GNU GENERAL PUBLIC LICENSE", "Licensed under the GPLv3.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "SPDX-License-Identifier: LGPL-2.1-only", "Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE", "This library is distributed under the terms of the LGPL.",
    ),
    "AGPL": (
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE", "This program is distributed under the terms of the AGPL v3.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "Licensed under the three-clause BSD licence.", "BSD 3-Clause License", "This code is made available under the two-clause BSD license.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0.", "Mozilla Public License Version 2.0", "This file is subject to the terms of the MPL 2.0.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC", "ISC License", "Licensed under the terms of the ISC licence.",
    ),
    "CC BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "You are free to share and adapt the material as long as you give appropriate credit.", "Text available under CC BY 3.0.", "Creative Commons Attribution 4.0 International",
    ),
    "CC BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "This text may be shared under CC BY-SA 3.0.", "Creative Commons Attribution-ShareAlike 4.0 International",
    ),
    "CC BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "You may not use the material for commercial purposes under CC BY-NC-SA 4.0.", "This text may be shared under CC BY-NC 3.0.", "Creative Commons Attribution-NonCommercial 4.0 International",
    ),
    "Public domain": (
        "This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal.", "Released into the public domain under CC0.", "SPDX-License-Identifier: Unlicense", "This work is in the public domain.",
    ),
    "Proprietary": (
        "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "All rights reserved.", "Copyright by the authors. All rights reserved.", "No part of this work may be copied without written permission.",
    ),
}

#: Lines that use the same words and grant nothing.
NEAR_MISSES: tuple[str, ...] = (
    "The city issued him a driving license after the second test.", "Fishing without a license is not permitted on the lake.", "Her poetic license was much admired by the public.", "The general public was free to use the library with or without a card.",
    "Version 2.0 of the report is made available under embargo.", "A copy of the letter was distributed to all members.", "The software was released in 2004 and ran on most computers.", "He studied at MIT and later worked for a commons.",
    "The Apache people lived in the south west.", "All rights of way are kept open by the council.", "They sell copies of the map without restriction.", "This program is on television every Monday.", "The permission slip must be signed and returned in writing.",
    "Commercial purposes were never part of the plan.", "Creative work needs common sense and attribution of ideas.", "The foundation published the free catalogue.", "Terms of the agreement were read aloud.", "Source and binary stars are listed in the table.",
)
